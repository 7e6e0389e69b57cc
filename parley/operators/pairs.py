"""Pair joins: neighbours by place, as-of, blocking keys, alignment, scores of clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def placed(messages: DataFrame, scope: str = "chat_id", order: tuple[str, ...] = ("us", "row_id")) -> DataFrame:
    return messages.withColumn("pos", F.row_number().over(W.partitionBy(scope).orderBy(*order)))


def neighbours(rows: DataFrame, radius: int, scope: str = "chat_id") -> DataFrame:
    """Pairs of rows at most ``radius`` places apart, each with the later one as ``b``: the rows before
    each one come from a window over the scope's order, so nothing is joined or shuffled again.
    Columns of both sides are prefixed a_ and b_."""
    columns = [c for c in rows.columns if c != scope]
    before = F.collect_list(F.struct(*columns)).over(W.partitionBy(scope).orderBy("pos").rowsBetween(-radius, -1))
    pairs = rows.withColumn("_before", before).select(F.col(scope).alias("scope"), *[F.col(c).alias(f"b_{c}") for c in columns], F.explode("_before").alias("_a"))
    return pairs.select("scope", *[F.col(f"_a.{c}").alias(f"a_{c}") for c in columns], *[f"b_{c}" for c in columns])


def rank_near_blocks(rows: DataFrame, keys: dict[str, Column], radius: int, scope: str, order: list[str], row: str) -> DataFrame:
    """Candidate pairs by blocking: rows that share a key in a scope and are at most ``radius`` ranks
    apart under it. a < b in order; ``reasons`` are the keys, sorted."""
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), c.cast("string").alias("key")) for n, c in keys.items()]))
    keyed = rows.select(F.col(scope).alias("scope"), F.col(row).alias("b"), *[F.col(c).alias(f"o_{c}") for c in order], parts.alias("p")).where("p.key IS NOT NULL")
    block = W.partitionBy("scope", "p.reason", "p.key").orderBy(*[f"o_{c}" for c in order]).rowsBetween(-radius, -1)
    pairs = keyed.withColumn("before", F.collect_list("b").over(block)).select(F.explode("before").alias("a"), "b", F.col("p.reason").alias("reason"))
    return pairs.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def as_of(left: DataFrame, right: DataFrame, scope: str, us: str, within_us: int) -> DataFrame:
    """For every row of left (scope, us, row_id) the latest row of right before it within the limit:
    one window over both, no join. Adds right_row and right_us."""
    both = left.select(scope, us, "row_id", F.lit(1).alias("side")).unionByName(right.select(scope, us, "row_id", F.lit(0).alias("side")))
    order = W.partitionBy(scope).orderBy(us, "side", "row_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("side") == 0, F.struct(F.col("row_id"), F.col(us))), ignorenulls=True).over(order)
    rows = both.withColumn("r", last).where("side = 1")
    fits = F.col(us) - F.col(f"r.{us}") <= within_us
    return rows.select(scope, us, "row_id", F.when(fits, F.col("r.row_id")).alias("right_row"), F.when(fits, F.col(f"r.{us}")).alias("right_us"))


def cluster_sizes(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Counts by (predicted, gold) cell with the totals of its row and column: all that pairwise and
    B-Cubed scores need, without pairs."""
    cells = rows.groupBy(predicted, gold).agg(F.count("*").alias("n"))
    p = cells.groupBy(predicted).agg(F.sum("n").alias("np"))
    g = cells.groupBy(gold).agg(F.sum("n").alias("ng"))
    return cells.join(p, predicted).join(g, gold)
