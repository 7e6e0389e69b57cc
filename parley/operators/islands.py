"""Gap sessions, segments and blocks over ordered messages of a chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def gap_sessions(messages: DataFrame, minutes: float, scope: str = "chat_id", us: str = "us", row: str = "row_id") -> DataFrame:
    """Adds ``session`` (0, 1, ... in each scope): a new one where the gap is over ``minutes``."""
    order = W.partitionBy(scope).orderBy(us, row)
    new = (F.col(us) - F.lag(us).over(order) > F.lit(int(minutes * 60_000_000))).cast("int")
    return messages.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def balanced_chunks(messages: DataFrame, least: int, most: int) -> DataFrame:
    """Cuts sessions into the fewest chunks of ``least`` to ``most`` rows whose sizes differ by one at
    most; sessions that can't be cut so are dropped. Needs gap_sessions' columns."""
    whole = W.partitionBy("chat_id", "session")
    n = F.count("*").over(whole)
    parts = F.ceil(n / F.lit(most))
    rows = messages.withColumn("_n", n).withColumn("_parts", parts).where(F.col("_n") >= least * F.col("_parts"))
    i = F.row_number().over(whole.orderBy("us", "row_id")) - 1
    base, extra = F.floor(F.col("_n") / F.col("_parts")), F.col("_n") % F.col("_parts")
    front = extra * (base + 1)
    chunk = F.when(F.col("_i") < front, F.floor(F.col("_i") / (base + 1))).otherwise(extra + F.floor((F.col("_i") - front) / base))
    return rows.withColumn("_i", i).withColumn("chunk", chunk.cast("long")).drop("_n", "_parts", "_i")


def capped_packets(messages: DataFrame, minutes: float, most: int) -> DataFrame:
    """Adds session and packet: a packet ends at a gap, or at ``most`` rows. The row cap starts anew
    in each session, so it is the row number's quotient."""
    rows = gap_sessions(messages, minutes)
    i = F.row_number().over(W.partitionBy("chat_id", "session").orderBy("us", "row_id")) - 1
    return rows.withColumn("packet", F.floor(i / F.lit(most)).cast("long"))


def adaptive_cutoffs(messages: DataFrame) -> DataFrame:
    """chat_id, n_gaps, cutoff_us: the greater of 4 times the median and 2 times the third quartile
    of the gaps, null under three gaps."""
    order = W.partitionBy("chat_id").orderBy("us", "row_id")
    gaps = messages.withColumn("gap", F.col("us") - F.lag("us").over(order))
    cut = F.greatest(4 * F.percentile("gap", F.lit(0.5)), 2 * F.percentile("gap", F.lit(0.75)))
    return gaps.groupBy("chat_id").agg(F.count("gap").alias("n_gaps"), F.when(F.count("gap") >= 3, cut).alias("cutoff_us"))


def carried(column: Column, order) -> Column:
    """Last value known before the row."""
    return F.last(column, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
