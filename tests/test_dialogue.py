"""Thinning, fragments and pair models against plain loops."""

import random

from parley.operators.model import apply_pair_model
from parley.operators.thinning import similar_pairs, thinned
from parley.plans.dialogue import fragments, judge


def brute_thinned(rows, percent):
    kept, out = [], {}
    for i, family, grams in sorted(rows):
        g = set(grams)
        near = any(f == family and 100 * len(g & h) >= percent * len(g | h) and g & h for f, h in kept)
        out[i] = not near
        if not near:
            kept.append((family, g))
    return out


def test_thinned_equals_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        base = rows[rng.randrange(len(rows))][2] if rows and rng.random() < 0.6 else [f"g{rng.randrange(60)}" for _ in range(rng.randint(1, 8))]
        grams = sorted({g if rng.random() < 0.85 else f"g{rng.randrange(60)}" for g in base})
        rows.append((i, rng.choice("ab"), grams))
    df = spark.createDataFrame(rows, "id long, family string, grams array<string>")
    for percent in (50, 80):
        got = {r["id"]: r["kept"] for r in thinned(df, percent).collect()}
        assert got == brute_thinned(rows, percent) and not all(got.values())
    pairs = {(r["a"], r["b"]) for r in similar_pairs(df, 50).collect()}
    want = {(a, b) for a, f, g in rows for b, e, h in rows if a < b and f == e and set(g) & set(h) and 2 * len(set(g) & set(h)) >= len(set(g) | set(h))}
    assert pairs == want
    assert thinned(df.limit(0), 50).count() == 0


def test_fragments_have_exact_spans(spark):
    texts = [(1, 0, "user", "Hello thing was here.  Réaile outionment is fine? "), (1, 1, "assistant", "...!!\n\nx"), (2, 0, "user", ""), (3, 0, "user", None)]
    rows = fragments(spark.createDataFrame(texts, "chat_id long, pos long, role string, content string")).orderBy("chat_id", "pos", "start").collect()
    by = {(c, p): t for c, p, _, t in texts}
    spans = [by[r["chat_id"], r["pos"]][r["start"] : r["stop"]] for r in rows]
    assert spans == ["Hello thing was here", "Réaile outionment is fine", "x"]
    assert [r["state"] for r in rows] == ["done", "ongoing", "unknown"]
    assert [r["own"] for r in rows] == [None, "outionment", None]
    assert [r["actor"] for r in rows] == ["user", "Réaile", "assistant"]
    assert rows[1]["intent"] == "ask"


def test_pair_model_gets_each_pair_once(spark):
    rows = [(i, "x" * i, None if i % 3 == 0 else "y" * (2 * i)) for i in range(40)]
    got = apply_pair_model(spark.createDataFrame(rows, "k long, left string, right string"), ["k"], judge).collect()
    assert {r["k"]: r["answer"] for r in got} == {k: judge([(a, b or "")])[0] for k, a, b in rows}
