"""What the learning operators fit, held to plain computations; ties, long payloads and odd rows."""

import math
import random
import time

import numpy as np

import corpus_pipeline
from parley.llm import decontamination, language_id, quality_classifier, toxicity, warc
from parley.llm.common import shared_path
from tests.llm.conftest import prose


def test_ridge_equals_normal_equations_in_one_piece(spark):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randint(20, 90)) if i % 3 else "!!! " * rng.randint(3, 40)) for i in range(150)]
    labels = [(i, int(bool(i % 3)), "x") for i in range(150)] + [(7, 0, "x"), (8, None, "x"), (9999, 1, "x")]
    stats = quality_classifier.document_statistics(spark.createDataFrame(docs, "doc_id long, text string"))
    model = quality_classifier.fit(stats, spark.createDataFrame(labels, "doc_id long, quality int, stats string"))
    by = {r["doc_id"]: np.array(r["stats"], float) for r in stats.collect()}
    rows = [(by[i], y) for i, y, _ in labels if i in by and y is not None]  # doc 7 trains on both its labels
    x, y = np.stack([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert len(y) == 151 and np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    z = model.fourier(x)
    width, n = quality_classifier.STATISTICS, quality_classifier.FEATURES
    penalty = quality_classifier.RIDGE * len(y) * np.diag([1e-6] + [1 / width] * width + [1.0] * n)
    want = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(model.ridge(x), z @ want, atol=1e-6)
    bins = np.clip(np.floor(model.ridge(x) * quality_classifier.BINS), -quality_classifier.BINS, 2 * quality_classifier.BINS)
    knots = np.unique(bins)
    means = np.array([y[bins == b].mean() for b in knots])
    assert np.allclose(model.values, quality_classifier.isotonic(means, np.array([(bins == b).sum() for b in knots], float)))
    equal = model.score(np.stack([x[0], x[0]]))
    assert equal[0] == equal[1]


def test_fourier_features_approximate_a_gaussian_kernel(spark):
    rng = np.random.default_rng(1)
    d, n = quality_classifier.STATISTICS, 20_000
    model = quality_classifier.QualityModel(np.zeros(d), np.ones(d), rng.normal(0, math.sqrt(2 * quality_classifier.GAMMA), (d, n)), rng.uniform(0, 2 * np.pi, n), np.zeros(1), np.zeros(1), np.zeros(1))
    x = rng.normal(0, 0.5, (5, d))
    z = model.fourier(x)[:, 1 + d :]
    want = np.exp(-quality_classifier.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(z @ z.T, want, atol=0.05)


def test_log_odds_by_hand(spark):
    rows = [("bad", 1, 30), ("stem*", 2, 40), ("good", 90, 2), ("even", 50, 10), ("rare", 0, 3)]
    got = {r["token"]: r for r in toxicity.log_odds(spark.createDataFrame(rows, "token string, clean long, toxic long"), 250, 50).collect()}
    nc, nt = sum(r[1] for r in rows), sum(r[2] for r in rows)
    for token, c, t in rows:
        a = toxicity.PRIOR * (c + t)
        prior = toxicity.PRIOR * (nc + nt)
        odds = math.log((t + a) / (nt + prior - t - a)) - math.log((c + a) / (nc + prior - c - a))
        q = (c + t) / 300
        ratio = sum(k * math.log(k / e) for k, e in ((c, 250 * q), (250 - c, 250 * (1 - q)), (t, 50 * q), (50 - t, 50 * (1 - q))) if k)
        z = math.sqrt(2 * ratio)
        assert (token in got) == (z >= toxicity.NormalDist().inv_cdf(1 - 1 / 20) and c + t >= toxicity.TESTABLE), (token, z)
        if token in got:
            assert abs(got[token]["odds"] - odds) < 1e-9 and abs(got[token]["z"] - z) < 1e-9
    assert set(got) == {"bad", "stem*", "good"}


def test_token_counts_of_units(spark):
    docs = spark.createDataFrame([("Abcdefgh xyz xyz", 1), ("abcdefgz", 0), (None, 0)], "text string, toxic int")
    got = {r["token"]: (r["clean"], r["toxic"]) for r in toxicity.token_counts(docs).collect()}
    assert got["abcd*"] == got["abcdefg*"] == (1, 1) and got["xyz"] == (0, 1) and got["abcdefgh"] == (0, 1) and "abcdefgh*" not in got


def test_logistic_lambda_and_k():
    rng = np.random.default_rng(5)
    x = np.arange(-5, 12, 0.5)
    n = rng.integers(1, 40, len(x)).astype(float)
    y = rng.binomial(n.astype(int), 1 / (1 + np.exp(-(0.7 * x - 2)))).astype(float)
    offset, slope = toxicity.logistic(x, n, y)
    like = lambda a, b: (y * (a + b * x) - n * np.logaddexp(0, a + b * x)).sum()
    best = max(like(a, b) for a in np.arange(-4, 0, 0.05) for b in np.arange(0, 2, 0.02))
    assert like(offset, slope) >= best - 1e-6
    pairs = [(-0.7, 0.9), (2.0, 0.07), (3.5, 0.03)]
    assert abs(sum(p * math.exp(toxicity._lambda(pairs) * s) for s, p in pairs) - 1) < 1e-6
    gumbel = rng.gumbel(1.5, 1, 200_000)  # lambda S - ln n of segments is ln K plus a Gumbel variable
    assert abs(toxicity.gumbel_log_k(gumbel.mean()) - 1.5) < 0.02 and toxicity.gumbel_log_k(None) == 0


def test_equal_segments_keep_their_order():
    model = toxicity.ToxicityModel({"x": 2.0})
    assert toxicity.token_segments(*toxicity.scored_runs(model, "x a a a a a x a a a a a x".split())) == [(2.0, 0, 1), (2.0, 6, 7), (2.0, 12, 13)]
    assert toxicity.ToxicityModel({"abcd*": 1.0, "abcdef": 3.0}).weight("abcdef") == 3.0
    assert toxicity.ToxicityModel({"abcd*": 1.0}).weight("abcdzz") == 1.0 and toxicity.ToxicityModel({"abcd*": 1.0}).weight("abcd") is None


def test_repeated_passages_are_all_found():
    model = toxicity.ToxicityModel({"zapf": 2.5}, 1.0, 0.0, 1.0, -4.0)
    once = ["zapf"] * 3
    assert [(a, b) for _, a, b in toxicity.evidence_of(model, once + ["a"] * 50 + once)[1]] == [(0, 3), (53, 56)]


def test_more_toxic_text_never_scores_lower():
    rng = random.Random(8)
    for _ in range(300):
        model = toxicity.ToxicityModel({"x": rng.choice([0.05, 0.4, 2.5]), "y": 1.0, "n": -1.5}, rng.choice([0.3, 1.0, 2.0]), rng.choice([-2.0, 0.0, 3.0]))
        tokens = [rng.choice("xynaaaaa") for _ in range(rng.randint(0, 40))]
        more = list(tokens)
        more.insert(rng.randint(0, len(more)), rng.choice("xy"))
        assert toxicity.evidence_of(model, more)[0] >= toxicity.evidence_of(model, tokens)[0] - 1e-9


def test_best_evidence_is_the_best_choice_of_segments():
    rng = random.Random(9)
    for _ in range(200):
        scores = [rng.choice([-3.0, -1.0, 1.0, 2.0, 4.0]) for _ in range(rng.randint(1, 7))]
        base = rng.choice([-1.0, 0.5, 2.0, 5.0])
        best = -math.inf
        for marks in range(1, 1 << len(scores)):  # chosen places; segments are their runs, cut or not cut between neighbours
            chosen = [marks >> i & 1 for i in range(len(scores))]
            inner = sum(chosen[i] and chosen[i - 1] for i in range(1, len(scores)))
            runs = sum(chosen) - inner
            for cuts in range(inner + 1):
                best = max(best, sum(s for s, c in zip(scores, chosen) if c) - base * (runs + cuts))
        assert abs(toxicity.best_evidence(scores, 1.0, base) - best) < 1e-9


def test_scan_is_linear():
    start = time.time()
    assert len(toxicity.maximal_segments([1.0, -1.5] * 200_000)) == 200_000
    assert len(toxicity.maximal_segments([x for i in range(100_000) for x in (2.0 + i % 7, -1.5)])) >= 1
    assert time.time() - start < 4


def test_tied_languages_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "abab", "y"), (2, "abab", "x")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, language_id.F.lit(True), bits=10)
    got = language_id.predict(spark.createDataFrame([(9, "ab"), (9, "ab")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["x", "x"] and all(abs(r["score"] - 0.5) < 1e-6 for r in got)


def test_labels_with_clashing_columns(spark):
    rng = random.Random(2)
    docs = [(i, prose(rng, 30) + (" zapf" * 4 if i % 4 == 0 else "")) for i in range(200)]
    labels = [(i, int(i % 4 == 0), "t", 0.5, 1) for i, _ in docs]
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string, score double, fold int")).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.95


def test_archive_of_long_payloads_and_null_ids(spark):
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(32, 126, 2_500_000, dtype=np.uint8)).decode()
    rows = [(1, "u", long), (None, "v", "y" * 200), (3, None, long + "!"), (4, "w", long), (None, "v", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {(1, 2_500_000): ("response", None), (None, 200): ("response", None), (3, 2_500_001): ("response", None), (4, 2_500_000): ("revisit", 1), (None, 0): ("response", None)}
    path = shared_path(spark, "warc-long")
    warc.write_archive(pages, path)
    read = warc.read_archive(spark, path).where("page_id = 3").collect()
    assert len(read) == 1 and read[0]["payload"] == (long + "!").encode()


def test_proximity_of_null_and_empty_phrases(frame, spark):
    phrases = spark.createDataFrame([(0, None), (1, "!!"), (2, "one three")], "phrase_id long, text string")
    got = decontamination.proximity_matches(frame([(1, "One two three"), (2, None), (3, ""), (1, "One two three")]), phrases, span=3).collect()
    assert [tuple(r) for r in got] == [(2, 1, 0, 2)] * 2
    assert decontamination.proximity_matches(frame([(1, "a")]), phrases.limit(0), span=3).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(21)
    good = [prose(rng, 90) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t), 0.5) for i, t in enumerate(good)]
    rows += [(100, None, "en", "s", 0, 0.5), (101, "", "en", "s", 0, 0.5), (3, good[3], "en", "s", len(good[3]), 0.5), (None, good[4], "en", "s", len(good[4]), 0.5), (102, good[5], "en", "s", 1, 0.5)]
    labels = [(i, 1, 0) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    for folder, some in (("full", rows), ("none", [])):
        sf = f"file://{tmp_path}/{folder}"
        tables = {"documents": (some, schema), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": ([(1, prose(rng, 30))], "item_id long, text string")}
        for name, (data, columns) in tables.items():
            spark.createDataFrame(data, columns).write.parquet(f"{sf}/{name}.parquet")
        got = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in corpus_pipeline.run(spark, sf).collect())
        if folder == "none":
            assert got == []
        else:  # 102 copies 5; the repeated row of 3 and the row without an id stay
            assert got == sorted([*range(30), 3, 100, 101, -1])
