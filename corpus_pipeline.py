"""A corpus pipeline out of five training-data operators, each stage written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Decisions travel as ids of rows to drop, which are few beside the texts, so texts
are only shuffled where such ids are too many for a broadcast of checked size.

Defined cases: null texts count as empty. The quality classifier, PII and encoding act on rows. The
Jaccard join and decontamination decide by doc_id: rows that share one stay or go together, and
rows without one, which no decision can name, stay. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontamination, ngram_join, pii, quality_classifier
from parley.llm.common import Workspace, staged, table
from parley.llm.queries import tokenizer_path
from parley.llm.sentencepiece_codec import encode_decode

#: Ids up to which they are sent to every task: 8 MB of longs, some 50 MB as a hash table.
BROADCAST_IDS = 1_000_000


def _bounded(ids: DataFrame, label: str) -> DataFrame:
    """A table of ids, as a broadcast where it is small enough."""
    ids = staged(ids, label)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ``dropped`` (doc_id)."""
    return docs.join(_bounded(dropped.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = table(spark, sf_dir, "labels")
    labelled = _bounded(labels.where("quality IS NOT NULL").select("doc_id").distinct(), "labelled")
    stats = staged(quality_classifier.document_statistics(docs.join(labelled, "doc_id", "left_semi")), "quality-statistics")
    return quality_classifier.keep_good(docs, quality_classifier.fit(stats, labels))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    groups = ngram_join.ngram_jaccard_join(docs)
    return _without(docs, groups.where("component_id <> doc_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.decontamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is redacted; n_chars is that of the new text."""
    clean = pii.redact_documents(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with begin and end, their count, and hashes of ids and of the decoded text."""
    return encode_decode(docs, tokenizer_path(), with_ids=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: No SQL: classifiers and the tokenizer are beyond it. tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others wrote; a stage's table goes when the next one is written."""
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark)
    for name, stage in STAGES[:-1]:
        kept = work(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if id(docs) in work.paths:
            work.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
