"""Typed mentions and claims, spans against spans, graph rules of the contract."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from parley.functions import profiles
from parley.functions import text as T
from parley.operators import contract
from parley.operators.mentions import claims, found_in, trie, typed_mentions
from parley.operators.model import draws, merged_draws
from parley.operators.paging import stream_pages
from parley.operators.spans import alike, crossing, overlaps
from parley.plans.profiled import clause_words
from parley.sources import manifest

ENTRIES = [("as", "x"), ("as well", "y"), ("as well as", "z"), ("well done", "w"), ("not", "deny"), ("was", "report"), ("will", "plan"), ("with", "means")]


def longest_by_hand(words, entries):
    """Dictionary entries at their first words, the longest first, none inside another."""
    known, out, i = {tuple(e.split()): c for e, c in entries}, [], 0
    while i < len(words):
        n = max((k for k in range(1, 5) if tuple(w.lower() for w in words[i : i + k]) in known and len(words[i : i + k]) == k), default=0)
        if n:
            out.append((i, n, known[tuple(w.lower() for w in words[i : i + n])]))
        i += n or 1
    return out


def test_longest_entries_equal_plain_search():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice(["as", "well", "As", "done", "not", "and", "Berlin", "we"]) for _ in range(rng.randint(0, 15))]
        text = " ".join(words)
        at = [m.start() for m in re.finditer(r"\S+", text)]
        want = [(at[i], at[i + n - 1] + len(words[i + n - 1]), c) for i, n, c in longest_by_hand(words, ENTRIES)]
        got = [(s, e, kind) for _, kind, s, e, _ in found_in(text, trie(ENTRIES)) if kind not in ("name", "noun")]
        assert got == want


def test_values_are_normal_and_marks_inside_them_end_no_clause():
    text = "Send 3,5 kg by 2024-05-06 09:30 to anna@host.example.org. At 9:05 the net 10.0.0.1 was down! 1234 left"
    got = [(c, kind, value) for c, kind, s, e, value in found_in(text, trie(ENTRIES)) if kind not in ("noun",)]
    assert got == [
        (0, "quantity", "3.5 kg"), (0, "time", "2024-05-06T09:30"), (0, "mail", "anna@host.example.org"),
        (1, "time", "09:05"), (1, "address", "10.0.0.1"), (1, "report", "was"), (2, "number", "1234"),
    ]
    for _, _, s, e, value in found_in(text, {}):
        assert 0 <= s < e <= len(text)
    assert found_in("", {}) == [] and found_in("...", {}) == []


def test_claims_take_the_first_action_and_a_noun_for_a_name(spark):
    texts = [(1, "We was not with Bernadette. Nothing here"), (2, "It will rain tomorrow with thunder"), (3, None), (3, ""), (4, "no verb")]
    df = spark.createDataFrame(texts, "doc_id long, body string")
    got = sorted(tuple(r) for r in claims(typed_mentions(df, "doc_id", "body", ENTRIES), profiles.ACTIONS).collect())
    assert got == [(1, 0, "deny", "means", "bernadette", 0, "", 0), (2, 0, "plan", "means", "tomorrow", 0, "", 0)]
    assert typed_mentions(df.limit(0), "doc_id", "body", ENTRIES).count() == 0


def test_profile_has_dozens_of_words_a_language_and_each_once():
    words = [w for w, _ in profiles.entries()]
    assert len(words) == len(set(words)) > 120
    assert all(sum(len(x.split()) for x in classes.values()) >= 36 for classes in profiles.WORDS.values())


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)
    spans = lambda n: [(rng.randrange(3), (s := rng.randrange(600)), s + rng.randint(1, 400)) for _ in range(n)]
    a, b = sorted(set(spans(60))), sorted(set(spans(60)))
    x, y = (spark.createDataFrame(v, "doc long, start long, stop long") for v in (a, b))
    want = {(d, s, t, u, v, min(t, v) - max(s, u)) for d, s, t in a for e, u, v in b if d == e and min(t, v) > max(s, u)}
    found = overlaps(x, y, ["doc"])
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    close = {w for w in want if 100 * w[5] >= 60 * (w[2] - w[1] + w[4] - w[3] - w[5])}
    assert {tuple(r) for r in found.where(alike(60)).collect()} == close
    cross = {(d, s, t, u, v) for d, s, t in a for e, u, v in a if d == e and s < u < t < v}
    assert {tuple(r)[:5] for r in crossing(x, ["doc"]).collect()} == cross


def test_cycles_of_references(spark):
    rng = random.Random(5)
    for n in (1, 2, 30, 200):
        refs = {i: rng.choice([None, rng.randrange(n + 3), max(0, i - 1)]) for i in range(n)}
        on = set()
        for i in refs:
            at, seen = refs[i], set()
            while at in refs and at not in seen and at != i:
                seen.add(at)
                at = refs[at]
            if at == i:
                on.add(i)
        got = {r["id"] for r in contract.cycle_members(spark.createDataFrame(list(refs.items()), "id long, ref long")).collect()}
        assert got == on, n


def test_pairs_kept_apart_that_links_join(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    apart = spark.createDataFrame([(1, 3), (3, 7), (8, 7), (1, 99)], "a long, b long")
    assert contract.linked_apart(links, apart, "r", "x").collect()[0]["violations"] == 2


def test_redaction_of_columns_equals_the_expression(spark):
    texts = ["a@b.org or +1 (555) 010-2345", "sk-abcdefghijkl123 /usr/local/lib/x", None, "", "d41d8cd98f00b204e9800998ecf8427e", "a + b @ c - d / e"]
    df = spark.createDataFrame([(t, t) for t in texts], "t string, keep string")
    rows = T.redacted(df, "t").select("t", T.redact(F.col("keep")).alias("want")).collect()
    assert [r["t"] for r in rows] == [r["want"] for r in rows] and rows[0]["t"] == "[EMAIL] or [PHONE]"


PAGED = "root long, stream int, pos long, tokens long"


def pages_by_hand(streams, caps, budget):
    at, out = [0, 0, 0], []
    while any(at[k] < len(streams[k]) for k in range(3)):
        took, used, forced = [0, 0, 0], 0, False
        for k in range(3):
            while at[k] < len(streams[k]) and took[k] < caps[k]:
                item = streams[k][at[k]]
                if used + item <= budget:
                    took[k], used, at[k] = took[k] + 1, used + item, at[k] + 1
                    continue
                if not any(took):
                    took[k], used, at[k], forced = 1, item, at[k] + 1, True
                break
            if forced:
                break
        out.append((*took, used, "pending" if forced else "ready"))
    return out


def test_pages_of_three_streams_equal_the_loop(spark):
    rng = random.Random(9)
    roots = {r: [[rng.choice([1, 5, 9, 30, 80]) for _ in range(rng.randint(0, 9))] for _ in range(3)] for r in range(40)}
    rows = [(r, k, p, t) for r, streams in roots.items() for k, s in enumerate(streams) for p, t in enumerate(s)]
    rng.shuffle(rows)
    got = {}
    for x in stream_pages(spark.createDataFrame(rows, PAGED), (3, 2, 4), 40).orderBy("root", "page").collect():
        got.setdefault(x["root"], []).append((x["n0"], x["n1"], x["n2"], x["tokens"], x["status"]))
    assert got == {r: p for r, s in roots.items() if (p := pages_by_hand(s, (3, 2, 4), 40))}


def test_exports_show_all_files_or_none(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.range(500).selectExpr("id", "concat('tëxt ', id) AS t", "IF(id % 7 = 0, NULL, id) AS n").repartition(3)
    manifest.write(df, path, file_bytes=2_000)
    files = manifest.manifest_of(path)
    assert len(files) > 3 and sum(f.rows for f in files) == 500 and not [x for x in os.listdir(tmp_path / "out") if x.endswith(".jsonl") and x.startswith(".") and not x.endswith(".crc")]
    back = manifest.read(spark, path, "id long, t string, n long")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="finished export"):
        manifest.write(df, path)
    with open(tmp_path / "out" / files[0].name, "a") as f:
        f.write("{}\n")
    with pytest.raises(ValueError, match="not as the manifest says"):
        manifest.read(spark, path, "id long, t string, n long")
    broken = df.selectExpr("IF(id = 499, raise_error('x'), id) AS id")
    with pytest.raises(Exception):  # noqa: B017
        manifest.write(broken, f"file://{tmp_path}/broken")
    assert not os.path.exists(tmp_path / "broken" / manifest.MANIFEST)


def test_draws_are_bound_and_merged(spark):
    packets = spark.createDataFrame([(1, "a", ["m1", "m2", "m3"]), (2, "b", ["m1"])], "packet long, body string, handles array<string>")
    answers = {("a", 1): [["m1", "m2"], ["m9"]], ("a", 2): [["m2", "m3"]], ("a", 3): [["m3"]], ("b", 1): [["m1"]], ("b", 2): None, ("b", 3): []}

    def model(bodies, seeds):
        told = [answers[b, s] for b, s in zip(bodies, seeds)]
        return ["prose" if t is None else json.dumps([{"title": f"t{len(r)}", "importance": s, "refs": r} for r in t]) for t, s in zip(told, seeds)]

    got = sorted(tuple(r) for r in merged_draws(draws(packets, model, [1, 2, 3])).collect())
    # m1 m2 and m2 m3 share half; m3 is half of the smaller set then.
    assert got == [(1, 1, 0, 3, 3, "t2", 2, ["m1", "m2", "m3"]), (2, 1, 0, 1, 1, "t1", 1, ["m1"])]


def test_clause_words_by_profile(spark):
    df = spark.createDataFrame([(1, "Please write to a.b@host.org with Bernadette. Not now! 3.5 kg"), (2, None), (3, "")], "id long, body string")
    got = [(r["clause"], r["word"], r["class"], r["content"]) for r in clause_words(df, "id", "body").orderBy("id", "clause", "i").collect()]
    assert got == [
        (0, "please", "request", False), (0, "write", None, True), (0, "to", "place", False), (0, "with", "means", False), (0, "bernadette", None, True), (1, "not", "deny", False), (1, "now", None, False),
    ]
