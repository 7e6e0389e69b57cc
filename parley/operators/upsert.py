"""State by key out of append-only logs: upserts, protected writes, task states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def enrich_upsert(rows: DataFrame, keys: list[str], arrival: str, fill: list[str], identity: tuple[str, str], sticky: list[str], first: list[str]) -> DataFrame:
    """One row a key: ``fill`` columns take the last value that is not null or empty, the identity
    (name, confidence) the most confident one and the later of equals, ``sticky`` flags stay true
    once set, ``first`` columns keep what came first. One shuffle, partial sums before it."""
    name, confidence = identity
    known = F.col(name).isNotNull()
    some = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    best = F.max_by(F.when(known, F.struct(name, confidence)), F.when(known, F.struct(confidence, arrival)))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("versions"),
        *[F.max_by(F.when(some(c), F.col(c)), F.when(some(c), F.col(arrival))).alias(c) for c in fill],
        best.alias("_best"),
        *[F.bool_or(c).alias(c) for c in sticky],
        *[F.min_by(c, arrival).alias(c) for c in first],
    )
    return out.select(*keys, "versions", *fill, F.col(f"_best.{name}").alias(name), F.col(f"_best.{confidence}").alias(confidence), *sticky, *first)


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, as an aggregate so that keys combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def protected_latest(rows: DataFrame, keys: list[str], protected: str, order: list[str]) -> DataFrame:
    """Like latest_by_key, but a protected row outranks any that is not."""
    return latest_by_key(rows, keys, [protected, *order])


def task_states(log: DataFrame, key: str, retry: str, success: str, failure: str, claim: str, max_attempts: int) -> DataFrame:
    """task_id, attempts, status, retries from a log (kind, us, row_id): only what follows the last
    retry counts."""
    order = W.partitionBy(key).orderBy("us", "row_id").rowsBetween(W.unboundedPreceding, 0)
    rows = log.withColumn("_part", F.sum((F.col("kind") == retry).cast("int")).over(order))
    # Newest part last: counts by part, then the part with the highest number.
    parts = rows.groupBy(key, "_part").agg(F.count_if(F.col("kind").isin(claim, failure)).alias("attempts"), F.count_if(F.col("kind") == failure).alias("failed"), F.count_if(F.col("kind") == success).alias("done"))
    last = parts.groupBy(F.col(key).alias("task_id")).agg(F.max_by(F.struct("attempts", "failed", "done"), "_part").alias("p"), F.max("_part").alias("retries"))
    status = F.when(F.col("p.done") > 0, "succeeded").when(F.col("p.failed") >= max_attempts, "failed").otherwise("pending")
    return last.select("task_id", F.col("p.attempts").alias("attempts"), status.alias("status"), "retries")
