"""Quality classifier: random Fourier features over document statistics, ridge scores from
normal equations summed per partition, isotonic calibration.

Statistics are computed once for every document in a pass without a shuffle and staged in the
shared folder; labels join those short rows, not the texts. The ridge fits at most
``SAMPLE_ROWS`` labelled rows (taken by a hash of doc_id). Calibration pools adjacent
violators over scores summed into BINS bins of all the labelled training rows.

Defined cases: a null text counts as empty and gets a score like any text. Without training
rows every score is 0.5; with one label every score is that label. Repeated rows are scored
each; a doc_id with several labels trains on each of them. Columns beside doc_id, text
and quality are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded_fraction, chunks, crc_mod, filled, hash_fraction, raw_text, segment_sums, staged

THRESHOLD = 0.3
SAMPLE_ROWS = 200_000
FEATURES, GAMMA, RIDGE, BINS, SEED = 256, 0.15, 1e-3, 1000, 11
FIT_TASKS = 8
STATISTICS = 16
SENTENCE_END = re.compile(r"[.!?]+[\s]")
#: Byte classes: upper case, lower case, digit, white space, other ASCII; the last are bytes over 127.
CLASSES = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\r\x0b\x0c" else 4 if b < 128 else 5 for b in range(256)], np.uint8)
MARKS = b"|#*$%&!.,"


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS numbers for each text."""
    raw, offsets = raw_text(column)
    size = np.maximum(np.diff(offsets), 1)
    kind = CLASSES[raw]
    shares = [segment_sums((kind == k).astype(np.int8), offsets) / size for k in (0, 2, 3, 4, 5)]
    symbols = segment_sums(np.isin(raw, np.frombuffer(b"#*$%&", np.uint8)).astype(np.int8), offsets) / size
    pipes = segment_sums((raw == 124).astype(np.int8), offsets) / size
    bangs = segment_sums((raw == 33).astype(np.int8), offsets) / size
    stops = segment_sums(((raw == 46) | (raw == 44)).astype(np.int8), offsets) / size
    rows = []
    for text in column.to_pylist():
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        sentences = [x for x in text.replace("\n", ". ").split(". ") if x]
        n = max(len(words), 1)
        rows.append((
            np.log1p(len(words)), len(text) / n / 10, len(set(words)) / n, len(set(lines)) / max(len(lines), 1),
            len(set(sentences)) / max(len(sentences), 1), len(set(zip(words, words[1:], words[2:]))) / max(len(words) - 2, 1), np.log1p(len(lines)),
        ))
    own = np.array(rows, float).reshape(-1, 7)
    return np.column_stack([*shares, np.sqrt(symbols), np.sqrt(pipes), np.sqrt(bangs), np.sqrt(stops), own])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats. Every row, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                stats = statistics(filled(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(stats.astype(np.float32)), pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<float>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # ridge scores, ascending
    values: np.ndarray  # calibrated probability at each knot

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)
        return np.column_stack([np.ones(len(x)), x, z])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(stats), self.knots, self.values)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pools adjacent violators: the non-decreasing sequence nearest to values."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """``stats``: rows of document_statistics to learn from; ``labels``: doc_id, quality."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id"), F.col("quality").cast("double").alias("y"))
    labelled = staged(stats.join(known, "doc_id").select("doc_id", "stats", "y"), "quality-training")
    n = labelled.count()
    sample = labelled.where(hash_fraction(F.col("doc_id"), bounded_fraction(n, sample_rows), 3))
    rng = np.random.default_rng(SEED)
    moments = sample.agg(*[f(F.col("stats")[i].cast("double")).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(STATISTICS)]).toPandas().fillna(0).to_numpy(float)[0]
    mean, scale = moments[:STATISTICS], np.maximum(moments[STATISTICS:], 1e-6)
    model = QualityModel(mean, scale, rng.normal(0, np.sqrt(2 * GAMMA), (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(1), np.zeros(1), np.full(1, 0.5))
    if n == 0:
        model.weights = np.zeros(1 + STATISTICS + FEATURES)
        return model
    width = 1 + STATISTICS + FEATURES

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + 1))
        for frame in frames:
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096]
                z = model.fourier(np.stack(part["stats"]).astype(float))
                total += z.T @ np.column_stack([z, part["y"].to_numpy()])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    # A fixed number of partial sums, whatever the input.
    sums = sample.select("stats", "y").repartition(FIT_TASKS).mapInPandas(equations, "sums binary").toPandas()["sums"]
    total = sum(np.frombuffer(s, float).reshape(width, width + 1) for s in sums)
    penalty = RIDGE * total[0, 0] * np.diag([1e-6] + [1.0 / STATISTICS] * STATISTICS + [1.0] * FEATURES)
    model.weights = np.linalg.solve(total[:, :width] + penalty, total[:, width])

    def ridged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.floor(model.ridge(np.array(batch.column(0).to_pylist(), float).reshape(-1, STATISTICS)) * BINS), -BINS, 2 * BINS)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(1)], names=["bin", "y"])

    bins = labelled.select("stats", "y").mapInArrow(ridged, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    model.knots = (bins["bin"].to_numpy(float) + 0.5) / BINS
    model.values = isotonic((bins["y"] / bins["n"]).to_numpy(), bins["n"].to_numpy(float))
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = m.score(np.array(batch.column(1).to_pylist(), float).reshape(-1, STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score ``threshold`` or more; texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(m.score(statistics(filled(part.column(place))).astype(np.float32).astype(float)) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, held: Column | None = None) -> DataFrame:
    """Contract columns. ``held`` marks the rows whose labels are not learned from."""
    held = crc_mod(F.col("doc_id"), 5) == 0 if held is None else held
    stats = staged(document_statistics(docs), "quality-statistics")
    model = fit(stats.where(~held), labels)
    return score(stats, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
