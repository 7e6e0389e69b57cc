"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of lower-cased code points are summed inside each task and
then by Spark; the log-probability matrix (languages x 2**bits, a fixed size for a language)
is broadcast, and texts are scored in numpy batches.

Defined cases: a null text and a text without a letter give ``und`` with score 0; so does
every text if there is no training row. Ties go to the language that sorts first. Repeated
rows are scored each. Only ``doc_id``, ``text`` and ``lang`` are read, whatever else the
table holds.
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

from parley.llm.common import chunks, crc_mod, filled, segment_sums

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
LETTER = re.compile(r"[^\W\d_]")
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass
class LanguageModel:
    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets
    bits: int


def hashed_ngrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text after text and order after order, and how many each text has."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, lowered), np.int64, len(lowered))
    ends = np.repeat(np.cumsum(lens), lens)
    at = np.arange(len(codes))
    buckets, owners = [], []
    for order in ORDERS:
        inside = at[at + order <= ends]
        h = np.full(len(inside), order, np.uint32)
        for k in range(order):
            h = (h ^ codes[inside + k]) * MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        buckets.append((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits))
        owners.append(np.searchsorted(np.cumsum(lens), inside, side="right"))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), np.bincount(owner, minlength=len(texts))


def fit(docs: DataFrame, train: Column, bits: int = 14, alpha: float = 0.2) -> LanguageModel:
    """Learn from all rows where ``train`` holds and lang is not null."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch):
                frame = pd.DataFrame({"lang": part.column(1).to_pylist(), "text": filled(part.column(0)).to_pylist()})
                for lang, texts in frame.groupby("lang")["text"]:
                    h, _ = hashed_ngrams(list(texts), bits)
                    sums = totals.setdefault(lang, np.zeros(size + 1, np.int64))
                    sums[:size] += np.bincount(h, minlength=size)
                    sums[size] += len(texts)
        for lang, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(sums[at])})

    rows = (
        docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most 2**bits + 1 rows a language
    )
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), size + 1))
    if langs:
        counts[np.searchsorted(langs, rows["lang"]), rows["bucket"]] = rows["n"]
    prob = (counts[:, :size] + alpha) / (counts[:, :size].sum(1, keepdims=True) + alpha * size)
    return LanguageModel(langs, np.log(counts[:, size]) - np.log(max(counts[:, size].sum(), 1)), np.log(prob).astype(np.float32), bits)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(batch):
                texts = filled(part.column(1)).to_pylist()
                known = np.array([bool(m.langs) and LETTER.search(t) is not None for t in texts])
                best, top = np.zeros(len(texts), int), np.zeros(len(texts))
                if known.any():
                    h, n = hashed_ngrams(texts, m.bits)
                    offsets = np.concatenate([[0], np.cumsum(n)])
                    logs = np.stack([p + segment_sums(row[h].astype(np.float64), offsets) for p, row in zip(m.log_prior, m.log_prob)], 1)
                    best = logs.argmax(1)
                    top = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                pred = [m.langs[b] if k else UNDETERMINED for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, top, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Contract columns: learn where crc32(doc_id) mod 4 is not 2, predict every document."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs, ~held)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
