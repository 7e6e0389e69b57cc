"""Thinning of near duplicates: in order, a row goes that is too similar to an earlier one that stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.operators.graph import checkpointed


def similar_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b) of rows (id, family, grams) of one family with a Jaccard similarity of at least
    ``percent``. Rows meet on their rarest grams only: of n, all but ceil(t n) - 1 of the common ones."""
    grams = rows.select("id", "family", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counts = grams.groupBy("family", "gram").agg(F.count("*").alias("df")).where("df > 1")
    lists = grams.join(counts, ["family", "gram"]).groupBy("id", "family", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("t"))
    keep = F.size("t") - F.ceil(percent * F.col("n") / 100).cast("int") + 1
    keys = lists.withColumn("keep", keep).where("keep > 0").select("id", "family", "n", F.explode(F.transform(F.slice("t", F.lit(1), F.col("keep")), lambda x: x["gram"])).alias("gram"))
    other = keys.select("family", "gram", F.col("id").alias("b"), F.col("n").alias("m"))
    near = keys.join(other, ["family", "gram"]).where(f"id < b AND 100 * least(n, m) >= {percent} * greatest(n, m)").select(F.col("id").alias("a"), "b").distinct()
    x, y = (rows.select(F.col("id").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
    both = near.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("ga", "gb")))
    return both.where(100 * F.col("i") >= percent * (F.size("ga") + F.size("gb") - F.col("i"))).select("a", "b")


def kept_in_order(edges: DataFrame) -> DataFrame:
    """id, kept of every id that edges (a, b) name, a coming before b: in rounds, what no undecided or kept
    row comes before stays, and what follows a kept one goes; a round decides the first of every undecided
    group at least."""
    edges = checkpointed(edges.distinct())
    state = checkpointed(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while state.where("kept IS NULL").limit(1).count():
        before = edges.join(state.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.bool_or("kept").alias("near"), F.count_if(F.col("kept").isNull()).alias("open"))
        step = state.join(before, "id", "left")
        decided = F.when(F.coalesce("near", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = checkpointed(step.select("id", F.coalesce("kept", decided).alias("kept")))
    return state


def thinned(rows: DataFrame, percent: int) -> DataFrame:
    """id, kept of rows (id, family, grams), in the order of ids. Of rows with equal grams all but the first
    go: what is similar to one is to the others, so they never come to pairs."""
    rows = rows.withColumn("grams", F.array_sort("grams"))
    copies = W.partitionBy("family", F.sha2(F.to_json("grams"), 256))
    first = checkpointed(rows.withColumn("first", (F.min("id").over(copies) == F.col("id")) | (F.size("grams") == 0)))
    state = kept_in_order(similar_pairs(first.where("first"), percent))
    return first.select("id", "first").join(state, "id", "left").select("id", (F.col("first") & F.coalesce("kept", F.lit(True))).alias("kept"))
