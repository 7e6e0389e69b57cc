"""Streams over the events files: what is new is read, once, and what comes out is a table in the
folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import stable_id
from parley.operators.graph import shared_folder

HOUR_US = 3_600_000_000


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/parley-stream-{name}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file (or folder of files) as a stream; a stream wants a pattern, and this one has
    no other match."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events[.]parquet")


def ingest_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Appends the stream, each event once within a day of its time, and returns what was written."""
    out = _folder(spark, name)
    rows = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    query = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _micros(at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), at.cast("timestamp_ntz"))


def hourly_counts_stream(spark: SparkSession, sf_dir: str, name: str, late: str = "1 day") -> DataFrame:
    """hour, kind, n, last_row. Windows of an hour of event time; the watermark lets go of those that are
    older than ``late``, so state is bounded. Each batch's changed windows are appended under the
    batch's number, and the newest row of a window counts."""
    out = _folder(spark, name)
    timed = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", "1 hour").alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_row"))
    counts = counts.select(F.floor(_micros(F.col("w.start")) / HOUR_US).alias("hour"), "kind", "n", "last_row")

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/number={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    newest = rows.groupBy("hour", "kind").agg(F.max_by(F.struct("n", "last_row"), "batch").alias("r"))
    return newest.select("hour", "kind", "r.n", "r.last_row")


def decision_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """row_id, reason, task_id of every event, once within a day of its time. A batch writes its decisions
    and its tasks under its number, so a batch that is repeated replaces what it wrote."""
    out = _folder(spark, name)
    rows = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    kind = F.col("event_type")
    reason = F.when(kind == "error", "from_self").when(~kind.isin("click", "view", "purchase"), "type").when(F.col("value") < 40, "no_rule").otherwise("reply")
    decided = rows.select(F.col("event_id").alias("row_id"), reason.alias("reason"))

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/decisions/number={number}")
        queued = spark.read.parquet(f"{out}/decisions/number={number}").where("reason = 'reply'")
        queued.select("row_id", stable_id("task", F.col("row_id")).alias("task_id")).write.mode("overwrite").parquet(f"{out}/tasks/number={number}")

    query = decided.writeStream.foreachBatch(append).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    decisions, tasks = (spark.read.parquet(f"{out}/{x}").drop("number") for x in ("decisions", "tasks"))
    return decisions.join(tasks, "row_id", "left").select("row_id", "reason", "task_id")
