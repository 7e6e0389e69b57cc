"""Toxic passages by maximum-scoring segment search over token log-odds.

Units, which are tokens and their beginnings of PREFIXES letters, get the log-odds ratio between
toxic and other training documents under an informative Dirichlet prior (the corpus background).
A unit counts if its likelihood ratio is such that only CHANCE of all units would reach it by
chance, so the bar follows the size of the sample. A token scores its own log-odds, else those of its longest
toxic beginning (words that the sample lacks are known by their stems), else it costs DRIFT.
A linear-time scan (Ruzzo and Tompa) finds all maximal scoring segments of a document, each is
judged by its extreme-value (Karlin-Altschul) expectation E = K n exp(-lambda S), n being the number
of tokens that don't gain. The evidence of a document is the largest sum of -ln E over disjoint
segments, and a logistic fit maps it to a probability, so another toxic token never lowers a score,
wherever it stands and however often it stands there already. K and the logistic fit come from
documents that the log-odds in use were not learned from (FOLDS).

The log-odds are learned on a bounded sample of labelled documents (SAMPLE_DOCS, by a hash of
doc_id), so the lexicon that is broadcast is bounded by that sample's tokens; scoring covers
every token of every document.

Defined cases: a null text is empty, has no segment and gets the score of no evidence. Without
labels of both kinds every score is the share of toxic training rows (0 without any). Repeated
rows are scored each; among maximal segments of equal score the earlier one comes first. Only
doc_id, text and toxic are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded_fraction, crc_mod, filled, hash_fraction, staged

TOKEN = re.compile(r"\w+")
SAMPLE_DOCS = 20_000
PREFIXES = (8, 7, 6, 5, 4)
#: PRIOR: weight of the background as a share of all counts. CHANCE: units that pass by chance, of
#: those in TESTABLE documents or more.
PRIOR, CHANCE, TESTABLE, DRIFT, SIGNIFICANT, FOLDS = 0.05, 20, 4, 0.7, 0.05, 2
#: Tokens whose score a task remembers.
CACHED = 200_000
EULER = 0.5772156649
BIN, LOW, HIGH = 4, -12, 60


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -math.inf

    cache: dict[str, float | None] = field(default_factory=dict, repr=False)

    def weight(self, token: str) -> float | None:
        """Score of a token, None for one that costs DRIFT."""
        if token in self.cache:
            return self.cache[token]
        get = self.weights.get
        found = get(token)
        if found is None:
            found = next((w for k in PREFIXES if len(token) > k and (w := get(token[:k] + "*")) is not None), None)
        if len(self.cache) >= CACHED:
            self.cache.clear()
        self.cache[token] = found
        return found

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if math.isinf(self.offset):  # labels of one kind only
            return np.full(len(evidence), float(self.offset > 0))
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * evidence, -700, 700)))


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, by start: Ruzzo-Tompa.

    Each kept segment links to the last one before it with a smaller total on its left, so the walk
    back passes over the others and the scan is linear."""
    starts: list[int] = []
    ends: list[int] = []
    left: list[float] = []  # totals before and after
    right: list[float] = []
    link: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        total += s
        if s <= 0:
            continue
        start, before = i, total - s
        j = len(starts) - 1
        while j >= 0 and left[j] >= before:
            j = link[j]
        while j >= 0 and right[j] < total:
            start, before, back = starts[j], left[j], link[j]
            del starts[j:], ends[j:], left[j:], right[j:], link[j:]
            j = back
        starts.append(start)
        ends.append(i + 1)
        left.append(before)
        right.append(total)
        link.append(j)
    return [(r - l, a, b) for a, b, l, r in zip(starts, ends, left, right)]


def scored_runs(model: ToxicityModel, tokens: list[str]) -> tuple[list[float], list[tuple[int, int]]]:
    """Scores in order with the tokens that each covers: runs of tokens that cost DRIFT are summed up,
    so the scans only visit tokens of the lexicon. Nothing where no token gains."""
    known = {t: w for t in set(tokens) if (w := model.weight(t)) is not None}
    scores: list[float] = []
    places: list[tuple[int, int]] = []
    if not any(w > 0 for w in known.values()):
        return scores, places
    last = -1
    for i, w in [(i, known[t]) for i, t in enumerate(tokens) if t in known]:
        if scores and i - last > 1:
            scores.append(-DRIFT * (i - last - 1))
            places.append((last + 1, i))
        scores.append(w)
        places.append((i, i + 1))
        last = i
    return scores, places


def token_segments(scores: list[float], places: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
    """Maximal segments of a document, in token positions."""
    return [(s, places[a][0], places[b - 1][1]) for s, a, b in maximal_segments(scores)]


def best_evidence(scores: list[float], lam: float, base: float) -> float:
    """The most that disjoint segments, one or more, bring together: lam times the score of each, less
    ``base``, which is what chance brings. One more token that gains never makes it less."""
    inside = done = -math.inf
    for s in scores:
        inside = max(inside, done - base, -base) + lam * s
        done = max(done, inside)
    return done


def evidence_of(model: ToxicityModel, tokens: list[str]) -> tuple[float, list[tuple[float, int, int]], float, int]:
    """Evidence of a document, its significant segments with their -ln E, its best score, and the tokens that don't gain.

    E is by the length of what could bring a segment by chance: the tokens that don't gain."""
    scores, places = scored_runs(model, tokens)
    segments = token_segments(scores, places)
    n = max(1, len(tokens) - sum(s > 0 for s in scores))
    if not segments:
        return float(LOW), [], 0.0, n
    base = model.log_k + math.log(n)
    good = [(x, a, b) for s, a, b in segments if (x := model.lam * s - base) >= -math.log(SIGNIFICANT)]
    return float(min(max(best_evidence(scores, model.lam, base), LOW), HIGH)), good, max(s for s, _, _ in segments), n


def _tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def units(tokens: set[str]) -> set[str]:
    """Tokens, and their beginnings with a star."""
    return tokens | {t[:k] + "*" for t in tokens for k in PREFIXES if len(t) > k}


def token_counts(docs: DataFrame) -> DataFrame:
    """Documents by unit and toxic, summed in each task and then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(filled(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
                sums[int(toxic > 0)].update(units(set(_tokens(text))))
        words = list(sums[0].keys() | sums[1].keys())
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"token": pa.array(part, pa.string()), "clean": pa.array([sums[0][w] for w in part], pa.int64()), "toxic": pa.array([sums[1][w] for w in part], pa.int64())})

    return docs.select(F.col("text").cast("string"), "toxic").mapInArrow(count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(counts: DataFrame, n_clean: int, n_toxic: int, prior: float = PRIOR, chance: float = CHANCE) -> DataFrame:
    """token, clean, toxic, odds for units whose share of documents differs significantly between
    n_clean and n_toxic documents (signed root of the likelihood ratio)."""
    total = counts.agg(F.sum("clean").alias("nc"), F.sum("toxic").alias("nt"), F.count_if(F.col("clean") + F.col("toxic") >= TESTABLE).alias("n")).first()
    nc, nt = float(total["nc"] or 0), float(total["nt"] or 0)
    z = NormalDist().inv_cdf(1 - chance / max(total["n"], 20 * chance))
    a = F.lit(prior) * (F.col("clean") + F.col("toxic"))
    prior *= nc + nt
    t, c = F.col("toxic") + a, F.col("clean") + a
    odds = F.log(t / (F.lit(nt + prior) - t)) - F.log(c / (F.lit(nc + prior) - c))
    share = (F.col("clean") + F.col("toxic")) / F.lit(float(n_clean + n_toxic))
    part = lambda seen, wanted: F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)
    ratio = sum(part(F.col(k), n * share) + part(n - F.col(k), n * (1 - share)) for k, n in (("clean", float(n_clean)), ("toxic", float(n_toxic))))
    rows = counts.withColumn("odds", odds).withColumn("z", F.sqrt(F.greatest(2 * ratio, F.lit(0.0))))
    return rows.where(F.col("z") >= z).where(F.col("clean") + F.col("toxic") >= TESTABLE).select("token", "clean", "toxic", "odds", "z")


def _lambda(pairs: list[tuple[float, float]]) -> float:
    """The positive root of sum(p exp(lambda s)) = 1, for scores with a negative mean."""
    low, high = 1e-3, 20.0
    f = lambda x: sum(p * math.exp(min(x * s, 700)) for s, p in pairs) - 1
    if f(high) < 0:
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope for n rows at each x, y of which are positive; Newton's method."""
    b = np.array([math.log((y.sum() + 1) / (n.sum() - y.sum() + 1)), 0.1])
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        h = design.T @ (design * (n * p * (1 - p) + 1e-6)[:, None]) + np.diag([1e-6, 1e-3])
        b = b + np.clip(np.linalg.solve(h, design.T @ (y - n * p) - np.array([1e-6, 1e-3]) * b), -2, 2)
    return float(b[0]), float(max(b[1], 0))


def lexicon(train: DataFrame) -> dict[str, float]:
    """Weights of units, of training documents (text, toxic)."""
    sides = train.agg(F.count_if(F.col("toxic") <= 0).alias("clean"), F.count_if(F.col("toxic") > 0).alias("toxic")).first()
    found = log_odds(token_counts(train), sides["clean"], sides["toxic"]).toPandas()
    # A unit that speaks for toxic text gains its log-odds, any other token costs DRIFT or more.
    weights = {t: o - DRIFT if o > 0 else min(o, -DRIFT) for t, o in zip(found["token"], found["odds"])}
    return {t: w for t, w in sorted(weights.items()) if w > 0 or not t.endswith("*")}


def score_shares(docs: DataFrame, model: ToxicityModel) -> list[tuple[float, float]]:
    """(score, share) of the tokens of documents (text), scores to two decimals."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for text in filled(batch.column(0)).to_pylist():
                for token, n in Counter(_tokens(text)).items():
                    w = shared.value.weight(token)
                    sums[-DRIFT if w is None else round(w, 2)] += n
        if sums:
            yield pa.RecordBatch.from_pydict({"score": pa.array(list(sums), pa.float64()), "n": pa.array(list(sums.values()), pa.int64())})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").collect()
    total = sum(r["n"] for r in rows)
    return [(r["score"], r["n"] / total) for r in rows]


def gumbel_log_k(lam_s: float | None) -> float:
    """ln K from the mean of lambda S - ln n over clean documents: the mean of a Gumbel variable less
    its place is Euler's constant."""
    return float(lam_s) - EULER if lam_s is not None else 0.0


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    known = labels.where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = known.where(hash_fraction(F.col("doc_id"), bounded_fraction(known.count(), sample_docs), 5))
    if sample.count() <= 2 * sample_docs:  # doc_id and a number each: a few hundred KB
        sample = F.broadcast(sample)
    # Of copies of a text one trains: they would pass for so many observations.
    train = docs.select("doc_id", "text").join(sample, "doc_id").where(F.col("text").isNotNull())
    train = train.groupBy(F.sha2("text", 256).alias("key")).agg(F.min_by(F.struct("text", "toxic"), F.struct("doc_id", "toxic")).alias("one"))
    train = staged(train.select("one.text", "one.toxic", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).alias("fold")), "toxicity-training")
    sides = {r["toxic"] > 0: r["n"] for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(sides) < 2:
        return ToxicityModel(offset=math.inf if sides.get(True) else -math.inf)
    scanned, known = None, []
    for fold in range(FOLDS):
        part, rest = ToxicityModel(lexicon(train.where(F.col("fold") != fold))), train.where(F.col("fold") == fold)
        part.lam = _lambda(score_shares(rest.where("toxic <= 0"), part) or [(-DRIFT, 1.0)])
        clean = _scan(rest.where("toxic <= 0"), part).where("best > 0")
        part.log_k = gumbel_log_k(clean.agg(F.avg(F.lit(part.lam) * F.col("best") - F.log(F.greatest("n", F.lit(1)))).alias("m")).first()["m"])
        known.append((part.lam, part.log_k))
        rows = _scan(rest, part)
        scanned = rows if scanned is None else scanned.unionByName(rows)
    bins = scanned.groupBy(F.round(F.col("evidence") * BIN).alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("y")).orderBy("bin").toPandas()
    offset, slope = logistic(bins["bin"].to_numpy(float) / BIN, bins["n"].to_numpy(float), bins["y"].to_numpy(float))
    lam, log_k = (sum(x) / FOLDS for x in zip(*known))
    return ToxicityModel(lexicon(train), lam, log_k, slope, offset)


def _scan(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """best, n, evidence and toxic of training documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = []
            for text, toxic in zip(filled(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
                tokens = _tokens(text)
                evidence, _, best, n = evidence_of(m, tokens)
                rows.append((best, n, evidence, toxic))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["best", "n", "evidence", "toxic"]).astype({"best": float, "n": "int64", "evidence": float, "toxic": "int32"}), preserve_index=False)

    return docs.select(F.col("text").cast("string"), "toxic").mapInArrow(run, "best double, n long, evidence double, toxic int")


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, passages: (start, end, bits) of significant segments in token positions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found, passages = [], []
            for text in filled(batch.column(1)).to_pylist():
                tokens = _tokens(text)
                e, good, *_ = evidence_of(m, tokens)
                found.append(e)
                passages.append([{"start": a, "end": b, "evidence": x} for x, a, b in good])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.probability(np.array(found))), pa.array(passages, pa.list_(passage))], names=["doc_id", "score", "passages"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start:int,end:int,evidence:double>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held: Column | None = None) -> DataFrame:
    """Contract columns, and the number of significant passages."""
    held = crc_mod(F.col("doc_id"), 5) == 0 if held is None else held
    model = fit(docs.where(~held), labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
