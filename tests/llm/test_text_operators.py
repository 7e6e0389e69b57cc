"""Operators whose results hold row by row, against brute force."""

import collections
import hashlib
import random
import re
import sys

import pytest
from tests.llm.conftest import prose
from pyspark.sql import functions as F

from parley.llm import license_scan, pii, quality_rules
from parley.llm.queries import tokenizer_path
from parley.llm.sentencepiece_codec import PieceModel, encode_decode


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_sentencepiece_matches_library(library):
    model, rng = PieceModel(tokenizer_path()), random.Random(3)
    parts = ["a", "b", "e", "th", "the", " ", "  ", "▁", "\n", "é", "日本", "ing", "0", "!!", "\x00", "�", "\U0001d4b3", "tion", "<s>", "</s>", "<0x41>", "<unk>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["th" * 1000, "a" * 3000, " " * 700, "the" * 90, "nt" * 128, "", " ", "▁"]
    # Long runs without a blank, of random letters, and of pieces whose merges may be overtaken.
    unsafe = [model.pieces[i].replace("▁", "") for i in model.unsafe.nonzero()[0]]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "then", "ab", "0aé日") for n in (200, 300, 2000)]
    texts += ["".join(rng.choice(unsafe) for _ in range(rng.randint(1, 200))) for _ in range(60)] + [p * 300 for p in rng.sample(unsafe, 20)]
    for text, ids in zip(texts, model.encode(texts)):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert model.decode(ids) == library.decode(ids.tolist())


def test_sentencepiece_query_columns(frame, odd_texts, library):
    got = sorted(encode_decode(frame(odd_texts), tokenizer_path(), with_ids=True).collect())
    want = []
    for i, t in odd_texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        text = library.decode(ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert [tuple(r) for r in got] == sorted(want)
    assert encode_decode(frame([]), tokenizer_path()).count() == 0


def brute_base(text):
    found = []
    for k, kind in enumerate(pii.BASE_KINDS):
        for m in pii.BASE[kind].finditer(text):
            s = m.group()
            digits = [int(c) for c in s if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


sys.set_int_max_str_digits(0)
PERSONAL = [
    "mail a.b@c.example.com now", "ip 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (811) 555-3281.",
    "+49 30 123456789 and x@y.z, ünï 日 127.0.0.1", "0001.02.3.0004", "9" * 5000 + ".1.1.1", "@ @@ a@b", "a@b@c.d@e.f", "a@b.c@d.e", "..@a.b", "1.2.3.4.5.6.7.8.9", "1.2.3", "+1 2", "4" * 30,
]


def test_pii_base_spans_and_redaction(frame, odd_texts):
    texts = odd_texts + [(100 + i, t) for i, t in enumerate(PERSONAL)] + [(200 + i, PERSONAL[i % 4] + f" x{i}") for i in range(60)]
    rows = pii.pii(frame(texts), with_text=True).collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in texts:
        for r in by[i]:
            base = brute_base(t or "")
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            every = set(filter(None, r["spans"].split(",")))
            assert set(filter(None, base.split(","))) <= every
            assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x.startswith(k) for x in base.split(",")) for k in pii.BASE_KINDS]
            assert not brute_base(r["redacted"]).count("email")
    assert pii.pii(frame([])).count() == 0


def test_pii_trees_tell_formats_apart():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    trees = pii.Trees(x, y)
    assert ((trees.predict(x) > 0.5) == y).mean() > 0.97


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base(frame, odd_texts):
    rng = random.Random(5)
    texts = odd_texts + [(100, "a b c a b c"), (101, "x x x x"), (102, "a\na\n \na"), (103, "#*$%&|<>"), (104, " ".join(rng.choice("ab") for _ in range(300)))]
    texts += [(200 + i, prose(rng, 120)) for i in range(40)] + [(300 + i, "!! ## " * 60) for i in range(10)]
    rows = quality_rules.quality_rules(frame(texts))
    assert len(rows.collect()) == len(texts)
    got = {r["doc_id"]: r for r in rows.collect()}
    for i, t in texts:
        r = got[i]
        want = brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(got[200 + i]["kept"] for i in range(40)) and not any(got[300 + i]["kept"] for i in range(10))
    assert quality_rules.quality_rules(frame([])).count() == 0


def test_quality_rules_windows(frame, odd_texts):
    """Statistics are exact whatever bits of hashes windows share, and nothing is sorted by an interpreted comparison."""
    rng = random.Random(11)
    texts = odd_texts + [(100 + i, rng.choice(["", " ", "\r\n"]).join(["".join(rng.choice(["a", "b", "\u00e9", "\U0001f600", "A", "1", "!", " ", "  ", "\t", "\n", "\x0b\x0c", "\r", "\u00a0", "\u2028", "\x1c"]) for _ in range(rng.randint(0, 60))) for _ in range(2)])) for i in range(150)]
    texts += [(300, "x " * 500), (301, "a b c d " * 3), (302, "a b c"), (303, "a b c a b c"), (304, prose(rng, 400)), (305, "ab c d a bc d ab c d")]
    assert "array_sort" not in quality_rules.statistics(frame(texts))._jdf.queryExecution().optimizedPlan().toString()
    for hashed in (F.xxhash64, lambda *words: F.lit(0).cast("long"), lambda *words: F.shiftleft(F.xxhash64(*words), 61)):
        stats = quality_rules.statistics(frame(texts), hashed)
        rows = stats.collect()
        assert len(rows) == len(texts)
        got = {r["doc_id"]: r for r in rows}
        for i, t in texts:
            t, r = t or "", got[i]
            words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(t)
            count = lambda pattern: len(re.findall(pattern, t))
            assert (r["n_lines"], r["n_distinct"], r["n_upper"], r["n_marks"], r["n_ends"], r["n_other"]) == (len(lines), len(set(words)), count("[A-Z]"), count("[!?]"), count("[.!?]"), count("[!-@\\[-`{-~]"))


def test_label_model_recovers_rule_accuracy(spark):
    rng = random.Random(2)
    accuracy = {"a": 0.95, "b": 0.8, "c": 0.7, "d": 0.55}
    data = []
    for _ in range(4000):
        good = rng.random() < 0.7
        data.append([(1 if (rng.random() < p) == good else -1) if rng.random() < 0.9 else 0 for p in accuracy.values()])
    model = quality_rules.fit(spark.createDataFrame(data, list(accuracy)), list(accuracy))
    for rule, p in accuracy.items():
        t = model.tables[rule]
        assert abs(t[1][1] / (t[1][1] + t[-1][1]) - p) < 0.08, rule
    assert abs(model.prior - 0.7) < 0.08


def brute_posteriors(votes, rounds):
    """Expectation maximisation document by document, from two starts; the likelier one's posteriors."""
    import numpy as np

    votes = np.array(votes)
    held = max(4.0, quality_rules.PRIOR_SHARE * len(votes))
    values = [sorted({*votes[:, r].tolist(), 0}) for r in range(votes.shape[1])]
    best = None
    for start in (None, np.where((votes == -1).any(axis=1), 0.1, 0.9)):
        p = start
        for step in range(rounds + 1):
            weights = [np.zeros(len(votes))] * 2 if p is None else [1 - p, p]
            share = []
            for k, w in enumerate(weights):
                counts = [np.array([held * quality_rules.START[k][v] + w[votes[:, r] == v].sum() for v in vs]) for r, vs in enumerate(values)]
                share.append([np.clip(c / c.sum(), 1e-5, 1) for c in counts])
            n = 0 if p is None else len(votes)
            prior = (quality_rules.START_GOOD * held + weights[1].sum()) / (held + n)
            like = [np.prod([[share[k][r][values[r].index(v)] for r, v in enumerate(row)] for row in votes], axis=1) for k in (0, 1)]
            p = prior * like[1] / (prior * like[1] + (1 - prior) * like[0])
            if step == rounds:
                fit = np.log(prior * like[1] + (1 - prior) * like[0]).sum() + held * (quality_rules.START_GOOD * np.log(prior) + (1 - quality_rules.START_GOOD) * np.log(1 - prior))
                fit += sum(held * quality_rules.START[k][v] * np.log(share[k][r][i]) for k in (0, 1) for r, vs in enumerate(values) for i, v in enumerate(vs))
                best = max(best or (-np.inf, None), (fit, p), key=lambda x: x[0])
    return best[1]


def test_quality_rules_posteriors(frame):
    """Posteriors equal those of a plain EM over documents; defects that pass the base rules go and
    running text stays."""
    rng = random.Random(7)
    sentence = lambda n: " ".join(rng.choice("alpha beta gamma delta north river stone table light open".split()) + rng.choice("abcdefghij") for _ in range(n)).capitalize() + "."
    texts = [(i, " ".join(sentence(12) for _ in range(rng.randint(6, 20)))) for i in range(200)]
    texts += [(500 + i, " ".join(w + rng.choice(["%%%", "$$$", "&&&"]) for w in sentence(90).split())) for i in range(25)]
    texts += [(600 + i, sentence(110).upper().replace(" ", "!! ")) for i in range(12)]
    rows = quality_rules.quality_rules(frame(texts)).collect()
    assert all(r["kept"] == (r["doc_id"] < 500) for r in rows)
    assert not any(r["base_failed"] for r in rows)
    stats = quality_rules.statistics(frame(texts))
    votes = stats.select("doc_id", *[v.alias(k) for k, v in quality_rules.votes().items()]).collect()
    want = brute_posteriors([list(r)[1:] for r in votes], quality_rules.ROUNDS)
    got = {r["doc_id"]: r["probability"] for r in rows}
    assert all(abs(got[r["doc_id"]] - p) < 1e-6 for r, p in zip(votes, want))


def brute_license(text, threshold=license_scan.THRESHOLD):
    low = str.maketrans(license_scan.UPPER, license_scan.LOWER)

    def grams(t):
        w = re.findall("[a-z0-9]+", t.translate(low))
        return set(zip(w, w[1:]))

    text = text or ""
    plain = lambda t: " ".join(re.findall("[a-z0-9]+", t.translate(low)))
    parts = [p for p in map(plain, re.split("\n[ \t\r]*\n", text)) if p]
    runs = {" ".join(parts[i : i + k]) for k in range(1, license_scan.RUN + 1) for i in range(len(parts) - k + 1)}
    units = {*map(plain, text.split("\n")), *runs, plain(text)}
    best, names, n = (0.0, None), set(), 0
    for u in units:
        g, hit = grams(u), False
        for name, t in license_scan.TEMPLATES:
            h = grams(t)
            if g and 200 * len(g & h) >= threshold * (len(g) + len(h)):
                hit = True
                names.add(name)
                best = min(best, (-2 * len(g & h) / (len(g) + len(h)), name), key=lambda x: (x[0], x[1] or ""))
        n += hit
    return best[1], -best[0], n, ",".join(sorted(names))


def test_license_scan(frame, odd_texts):
    of = lambda name: max((t for n, t in license_scan.TEMPLATES if n == name), key=len)
    mit, gpl, bsd = of("MIT"), of("GPL-3.0"), of("BSD-3-Clause")
    blocks = "The MIT License\n\nCopyright (c) 1999 A. N. Other\n\n" + mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n \t\nTHE")
    code = "\n\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(40))
    texts = odd_texts + [(100, f"x y\n{mit}\nz"), (101, mit.replace("software", "program")), (102, f"a\n\n{gpl.upper()}!!\n\nb\nReleased under the MIT License."), (103, "licensed under the"), (104, mit + "\n" + mit), (105, blocks + "\n\n" + code), (106, bsd.replace(": 1.", ":\n\n1.").replace(". 2.", ".\n\n2.").replace(". 3.", ".\n\n3.") + "\n\n" + code), (107, code)]
    got = license_scan.license_scan(frame(texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = dict(texts)[r["doc_id"]]
        name, dice, n, names = brute_license(t)
        assert (r["license"], r["n_matches"], r["licenses"]) == (name, n, names)
        assert abs(r["dice"] - dice) < 1e-9
    found = {r["doc_id"]: r["license"] for r in got}
    assert (found[105], found[106], found[107]) == ("MIT", "BSD-3-Clause", None)
    assert license_scan.license_scan(frame([])).count() == 0


def test_size_bounds_are_exact():
    for n in range(1, 60):
        least, most = license_scan.size_bounds(n)
        for m in range(1, 120):
            possible = 200 * min(n, m) >= license_scan.THRESHOLD * (n + m)
            assert possible == (least <= m <= most)


def test_native_plans_run_no_python(frame):
    d = frame([(1, "a b c")])
    for df in (license_scan.license_scan(d), quality_rules.quality_rules(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert d.select(F.lit(1)).count() == 1
