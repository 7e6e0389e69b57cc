"""Typed reads of the given tables, and the message views that the archive operators work on."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed messages: row_id, chat_id, ts, us (microseconds since 1970, UTC), kind, value, k."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("chat_id"),
        "ts",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("us"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def instant(us: int) -> Column:
    """A constant of the type of ``ts``, so that comparisons with it reach the scan."""
    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)
    return F.lit(str(at)).cast("timestamp_ntz")


def between(messages: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Rows of the half-open range, filtered on the stored time."""
    return messages.where((F.col("ts") >= instant(start_us)) & (F.col("ts") < instant(end_us)))


def turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns: chat_id, pos, role, is_self (true, false or unknown), content."""
    turns = table(spark, sf_dir, "conversations")
    is_self = F.when(F.col("role") == "assistant", True).when(F.col("role") == "user", False)
    return turns.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("pos"), "role", is_self.alias("is_self"), F.col("text").alias("content"))


def union_shards(shards: list[DataFrame]) -> DataFrame:
    """Appends shards; columns that a shard lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
