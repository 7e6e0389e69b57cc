"""Operators that learn from, or look across, the corpus: brute force, round trips, held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import decontamination, language_id, ngram_join, quality_classifier, toxicity, warc
from parley.llm.common import shared_path
from tests.llm.conftest import WORDS, prose

WORD = r"[^\x20\x09-\x0D]+"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Language identification


def test_language_id_learns_and_handles_odd_texts(spark, odd_texts):
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "edcxyz", "cc": "mnopé"}
    data = [(1000 + i, " ".join("".join(rng.choice(letters[l]) for _ in range(6)) for _ in range(30)), l, "s") for i in range(300) for l in [rng.choice(list(letters))]]
    data += [(i, t, None, "s") for i, t in odd_texts] + [(5000, "12 34 !?", "aa", "s")]
    got = language_id.language_id(spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string")).collect()
    assert len(got) == len(data)
    truth = {d[0]: d for d in data}
    right = total = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if 1000 <= r["doc_id"] < 5000 and r["held_out"]:
            total += 1
            right += r["lang_pred"] == truth[r["doc_id"]][2]
        if r["doc_id"] in (0, 1, 2, 5000):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert total > 40 and right == total


def test_language_id_by_plain_sums(spark):
    docs = spark.createDataFrame([(1, "abab", "x"), (2, "cdcd", "y"), (3, "cd", "y")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), bits=10)
    h, n = language_id.hashed_ngrams(["ab"], 10)
    want = model.log_prior + model.log_prob[:, h].sum(1)
    got = language_id.predict(spark.createDataFrame([(9, "ab")], "doc_id long, text string"), model).first()
    assert n.tolist() == [3] and got["lang_pred"] == model.langs[want.argmax()]
    assert abs(got["score"] - 1 / np.exp(want - want.max()).sum()) < 1e-6


def test_language_id_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.language_id(docs).collect()} == {("und", 0.0)}
    assert language_id.language_id(docs.limit(0)).count() == 0


# Quality classifier


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        data.append((i, prose(rng, rng.randint(60, 150)) + "." if good else (prose(rng, 8).upper() + " !!! ") * 12, "en", "s", 1))
        labels.append((i, int(good), int(rng.random() < 0.1), "x"))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string")


def test_quality_classifier_held_out(spark, frame, odd_texts):
    docs, labels = labelled(spark)
    got = quality_classifier.quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert len(got) == 400
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    odd = quality_classifier.quality(frame(odd_texts), labels).collect()
    assert len(odd) == len(odd_texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in odd)
    assert quality_classifier.quality(frame([]), labels).count() == 0
    assert {r["score"] for r in quality_classifier.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v, w = rng.random(7), rng.integers(1, 5, 7).astype(float)
        got = quality_classifier.isotonic(v, w)
        # max-min formula
        want = [max(min(np.average(v[a : b + 1], weights=w[a : b + 1]) for b in range(i, 7)) for a in range(i + 1)) for i in range(7)]
        assert np.allclose(got, want)


# Toxicity


def brute_segments(scores):
    """All maximal scoring segments by their recursive definition."""
    best, place = 0, None
    for a, b in itertools.combinations(range(len(scores) + 1), 2):
        s = sum(scores[a:b])
        if s > best or (s == best and place and (b - a < place[1] - place[0])):
            best, place = s, (a, b)
    if not place:
        return []
    a, b = place
    return brute_segments(scores[:a]) + [(best, a, b)] + [(s, x + b, y + b) for s, x, y in brute_segments(scores[b:])]


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-5, -3, -2, -1, 1, 2, 3, 4]) + rng.random() / 100 for _ in range(rng.randint(0, 12))]
        assert [(a, b) for _, a, b in toxicity.maximal_segments(scores)] == [(a, b) for _, a, b in brute_segments(scores)]
    for n in (60, 90):
        scores = [(1 if i % 2 else -1) * (rng.randint(1, 9) + rng.random() / 100) for i in range(n)]
        assert [(a, b) for _, a, b in toxicity.maximal_segments(scores)] == [(a, b) for _, a, b in brute_segments(scores)]


def test_toxicity_held_out(spark, frame, odd_texts):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(500):
        words = prose(rng, rng.randint(40, 120)).split()
        toxic = rng.random() < 0.25
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["zapf", "grumf", "blarg"])
        data.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 500 and sum(r["predicted"] == dict(labels)[r["doc_id"]] for r in held) / len(held) > 0.95
    model = toxicity.fit(docs, known)
    found = {r["doc_id"]: r["passages"] for r in toxicity.score(docs, model).collect()}
    for i, t in data[:100]:
        tokens = t.split()
        for p in found[i]:
            assert any(w in ("zapf", "grumf", "blarg") for w in tokens[p["start"] : p["end"]])
    odd = toxicity.toxicity(frame(odd_texts), known).collect()
    assert len(odd) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in toxicity.toxicity(docs, known.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), known).count() == 0


# WARC


def pages(spark):
    long, other = "<html>" + "é" * 100, "<p>" * 60
    rows = [(5, "http://a/x", long, 1), (2, None, long, 1), (9, "http://b/\r\ny z", long, 1), (3, "u", "short", 1), (4, "u", "short", 1), (7, "v", None, 1), (8, None, "", 1), (11, "w", other, 1), (12, "ü", other, 1), (13, "w", "x" * 300_000, 1), (9, "http://c", long, 1)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    first = {}
    for i, _, h, _ in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h or ""] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_pushdown_and_plain_gzip(spark, tmp_path):
    _, df = pages(spark)
    path = shared_path(spark, "warc-test")
    warc.write_archive(df, path)
    read = warc.read_archive(spark, path)
    assert {r["url"] for r in read.where("page_id = 9").collect()} == {"http://b/%0D%0Ay z", "http://c"}
    assert read.where("record_type = 'revisit' AND payload IS NULL").count() == 4
    slim = warc.read_archive(spark, path, "page_id long, record_type string, payload_bytes long")
    assert sorted(r["payload_bytes"] for r in slim.where(F.col("page_id").isin(3, 13)).collect()) == [5, 300_000]
    reader = warc.WarcReader(path, None)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.In(("page_id",), (1, 2)), warc.EqualTo(("payload_bytes",), 5)]))
    assert len(left) == 1 and reader.wanted == [("record_type", {"response"}), ("page_id", {1, 2})]
    # Records that another writer compressed, without the skip length.
    import gzip
    import io

    row = {"record_type": "response", "payload": b"abc", "payload_bytes": 3, "page_id": 1, "url": "u", "payload_digest": "d", "refers_to": None, "refers_to_url": None}
    plain = gzip.compress(gzip.decompress(warc.record(row)))

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    got = list(warc.records(Source(plain * 3), True, [("page_id", {1})]))
    assert [g["payload"] for g in got] == [b"abc"] * 3


# Decontamination


def brute_hits(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for s in range(max(len(v) - size + 1, 1) if v else 0):
            x = v[s : s + size]
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, frame, odd_texts):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([10, 11, 25, 3, 1, 12])] + [(20, None), (21, "!!"), (22, "Überall  DIE w1")]
    items.append((23, items[2][1]))
    texts = odd_texts + [(100 + i, prose(rng, 40) + " " + " ".join(t.split()[: rng.randint(8, 30)]).upper().replace(" ", ", ") + " " + prose(rng, 20)) for i, (_, t) in enumerate(items[:6] * 3)]
    texts += [(200, items[2][1] + " " + items[2][1]), (201, "x überall die-w1 y"), (202, " ".join(items[2][1].split()[:9])), (203, items[0][1]), (203, items[0][1])]
    df = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = decontamination.decontamination(frame(texts), df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == brute_hits(dict(texts)[r["doc_id"]], items), r["doc_id"]
    assert {r["n_hit"] for r in decontamination.decontamination(frame(texts), df.limit(0)).collect()} == {0}
    assert decontamination.decontamination(frame([]), df).count() == 0


def test_phrase_and_proximity_matches(spark, frame):
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice("abcde") for _ in range(40))) for i in range(6)]
    phrases = [(0, "a b"), (1, "c a e"), (2, "d")]
    got = {tuple(r) for r in decontamination.proximity_matches(frame(texts), spark.createDataFrame(phrases, "phrase_id long, text string"), span=6).collect()}
    want = set()
    for p, t in phrases:
        terms = t.split()
        for i, text in texts:
            w = text.split()
            for s in range(len(w)):
                at, ok = s, w[s] == terms[0]
                for term in terms[1:]:
                    at = next((j for j in range(at + 1, len(w)) if w[j] == term), None) if ok else None
                    ok = at is not None
                if ok and at - s < 6:
                    want.add((p, i, s, at))
    assert got == want
    exact = decontamination.phrase_matches(frame([(1, "x A b c y a b c")]), spark.createDataFrame([(7, "a b c")], "item_id long, text string"))
    assert {(r["doc_id"], r["start"], r["n_words"], r["item_id"]) for r in exact.collect()} == {(1, 1, 3, "7"), (1, 5, 3, "7")}


# N-gram Jaccard join


def shingles(text):
    w = re.findall(WORD, (text or "").translate(ASCII))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts, percent=80):
    sets, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, n=120):
    texts = []
    while len(texts) < n:
        base = prose(rng, rng.choice([1, 3, 5, 8, 20, 60, 150])).split()
        for _ in range(rng.choice([1, 1, 2, 8])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                words = words[rng.randint(0, 2) :] or words
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(frame, odd_texts, seed):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = odd_texts + [(100 + i, t) for i, t in enumerate(near_copies(rng))]
    texts += [(400 + i, passage + " " + prose(rng, rng.choice([3, 10, 60]))) for i in range(30)]
    texts += [(500 + i, passage.upper()) for i in range(5)]
    got = ngram_join.ngram_jaccard_join(frame(texts)).collect()
    want = brute_components(texts)
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_ngram_join_empty(frame):
    assert ngram_join.ngram_jaccard_join(frame([])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_jaccard_join(frame([(4, None)])).collect()] == [(4, 0, 4)]


def test_prefix_bounds():
    """Two sets at the similarity share enough shingles inside both first prefixes."""
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(1, 60)
        a = rng.sample(range(10_000), n)
        b = [x for x in a if rng.random() < 0.93] + rng.sample(range(10_000, 20_000), rng.randint(0, 4))
        if not b or 100 * len(set(a) & set(b)) < 80 * len(set(a) | set(b)):
            continue
        for share in (ngram_join.FIRST, 30):
            e = [set(sorted(s)[: ngram_join.extended_prefix(len(s), 80, share)]) for s in (a, b)]
            least = min(ngram_join.common_prefix(len(s), share) for s in (a, b))
            assert len(e[0] & e[1]) >= least
            for s in (a, b):
                assert ngram_join.common_prefix(ngram_join.required(len(s), 80), share) <= least


def test_ngram_join_shared_ids(frame):
    """Rows that share a doc_id are searched each by its own text."""
    rng = random.Random(12)
    a, b = prose(rng, 80), prose(rng, 80)
    texts = [(8, a), (8, b), (8, b), (20, a + " more"), (21, b + " more"), (22, b), (30, prose(rng, 80)), (30, prose(rng, 9))]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(frame(texts)).collect()}
    assert got == {(8, 76, 8), (20, 77, 8), (21, 77, 8), (22, 76, 8), (30, 76, 30), (30, 5, 30)}
    own = [(4, a), (4, b), (7, b + " more"), (9, a + " more")]
    frames = ngram_join.ngram_jaccard_join(frame([(40, a), (6, a + " x"), (40, b), (50, b + " y")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in frames) == [(6, 6), (40, 6), (40, 40), (50, 40)]
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(frame(own)).collect()} == {(4, 4), (7, 4), (9, 4)}


def test_ngram_join_borderline_mass(frame):
    """Copies of one text whose similarities lie on both sides of the threshold."""
    rng = random.Random(13)
    base = prose(rng, 100).split()
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(100)] = rng.choice(WORDS[:40])
        texts.append((i, " ".join(words[: rng.randint(88, 100)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(frame(texts)).collect()}
    assert got == brute_components(texts)


# Pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    docs, labels = labelled(spark, 160, 5)
    rows = [tuple(r) for r in docs.collect()]
    items = [(1, prose(rng, 30))]
    extra = [(1000, rows[next(i for i, r in enumerate(rows) if r[1][0] == "w")][1]), (1001, prose(rng, 60) + " " + items[0][1]), (1002, prose(rng, 90) + " mail me@here.example.com"), (1003, prose(rng, 90))]
    rows += [(i, t, "en", "s", len(t)) for i, t in extra]
    docs = spark.createDataFrame(rows, docs.schema)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        now.write.parquet(f"{sf}/{name.replace(' ', '_')}")
        now = spark.read.parquet(f"{sf}/{name.replace(' ', '_')}")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        assert name == "sentencepiece" or now.columns == docs.columns
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} | {1000, 1001, 1002, 1003}
    assert len(set(seen["quality classifier"]) ^ good) <= 3
    kept = seen["quality classifier"]
    groups = brute_components([(i, r["text"]) for i, r in kept.items()])
    assert set(seen["n-gram jaccard join"]) == {i for i, (_, root) in groups.items() if i == root} and 1000 not in seen["n-gram jaccard join"]
    clean = {i for i, r in seen["n-gram jaccard join"].items() if not brute_hits(r["text"], items)[4]}
    assert set(seen["benchmark decontamination"]) == clean and 1001 not in clean and {1002, 1003} <= clean
    redacted = seen["pii"][1002]
    assert redacted["text"].endswith("mail [EMAIL]") and redacted["n_chars"] == len(redacted["text"]) and set(seen["pii"]) == clean
    assert set(seen["sentencepiece"]) == clean
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {i: r["ids_sha256"] for i, r in seen["sentencepiece"].items()}
    assert collections.Counter(len(s) for s in corpus_pipeline.STAGES) == {2: 5}
