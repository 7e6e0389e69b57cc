"""Spans against spans: which of two sets overlap, met in buckets of positions instead of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a bucket; a span of n characters has n / WIDTH + 2 at most.
WIDTH = 128


def bucketed(spans: DataFrame) -> DataFrame:
    last = F.greatest(F.col("start"), F.col("stop") - 1)
    return spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / WIDTH), F.floor(last / WIDTH))))


def overlaps(left: DataFrame, right: DataFrame, scope: list[str]) -> DataFrame:
    """scope, start and stop of both sides (a_, b_), shared: pairs of spans (scope, start, stop) that have characters
    in common. Each pair is met where the later one begins, so once."""
    a = bucketed(left.select(*scope, "start", "stop")).withColumnsRenamed({"start": "a_start", "stop": "a_stop"})
    b = bucketed(right.select(*scope, "start", "stop")).withColumnsRenamed({"start": "b_start", "stop": "b_stop"})
    begin, end = F.greatest("a_start", "b_start"), F.least("a_stop", "b_stop")
    pairs = a.join(b, [*scope, "bucket"]).where((begin < end) & (F.floor(begin / WIDTH) == F.col("bucket")))
    return pairs.select(*scope, "a_start", "a_stop", "b_start", "b_stop", (end - begin).alias("shared"))


def alike(percent: int) -> Column:
    """Shared characters as a share of all that either span has."""
    return 100 * F.col("shared") >= percent * (F.col("a_stop") - F.col("a_start") + F.col("b_stop") - F.col("b_start") - F.col("shared"))


def crossing(spans: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs of spans of one set where neither holds the other."""
    a, b = (F.col("a_start"), F.col("a_stop")), (F.col("b_start"), F.col("b_stop"))
    return overlaps(spans, spans, scope).where((a[0] < b[0]) & (b[0] < a[1]) & (a[1] < b[1]))
