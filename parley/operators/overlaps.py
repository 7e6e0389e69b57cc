"""Overlaps of queried sets with all sets. Sets stay where they are and queries go to them, so pairs are counted
inside a partition and never shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.graph import checkpointed

#: References of queries that are sent to every task at a time, some 100 bytes each in a hash table.
QUERY_REFS = 1_000_000
#: The same where a query may meet every row of its scope: with the rows of a task they bound its pairs.
TERM_REFS = 250_000
#: Rows of a partition: what bounds the pairs that one task counts at a time.
PARTITION_ROWS = 40_000


def citation_overlaps(rows: DataFrame, every: int, block: int = QUERY_REFS) -> DataFrame:
    """a, b, shared: leads b whose references overlap those of a queried lead a (its id divides by ``every``) by half of
    the smaller set, rounded up. ``rows``: lead, ref; repeated ones count once."""
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    sets = checkpointed(rows.repartition(parts, "lead").groupBy(F.col("lead").alias("b")).agg(F.collect_set("ref").alias("refs")).withColumn("m", F.size("refs")))
    asked = sets.where(F.col("b") % every == 0).select(F.col("b").alias("a"), F.col("m").alias("n"), F.explode("refs").alias("ref"))
    blocks = max(1, -(-asked.count() // block))
    # A row a lead, with all queries that it meets: partitions keep leads whole, so pairs are grouped where they are.
    refs = sets.repartition(parts, "b").select("b", "m", F.explode("refs").alias("ref"))
    found = None
    for k in range(blocks):
        some = F.broadcast(asked.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == k))
        pairs = refs.join(some, "ref").where("a <> b").groupBy("b", "a").agg(F.count("*").alias("shared"), F.any_value(F.least("n", "m")).alias("smaller"))
        near = pairs.where("shared >= floor((smaller + 1) / 2)").select("a", "b", "shared")
        found = near if found is None else found.unionByName(near)
    return found


def best_overlaps(rows: DataFrame, every: int, most: int, block: int = TERM_REFS, cell_rows: int = PARTITION_ROWS) -> DataFrame:
    """query, found, shared, place: of each row whose id ``every`` divides the ``most`` others of its scope that share the
    most terms with it, then the smallest ids. ``rows``: id, scope (one an id), term.

    Rows lie in cells of a scope, about ``cell_rows`` in a task. A task counts pairs of its own rows and a block of
    queries, and sends on the best of each query."""
    rows = checkpointed(rows.where("id IS NOT NULL AND scope IS NOT NULL AND term IS NOT NULL").select("id", "scope", "term"))
    sizes = rows.groupBy("scope").agg(F.ceil(F.count("*") / cell_rows).alias("cells"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // cell_rows))
    cells = rows.join(sizes, "scope").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells"))).drop("cells")
    cells = cells.withColumnRenamed("id", "found").repartition(parts, "scope", "cell")
    asked = rows.where(F.col("id") % every == 0).withColumnRenamed("id", "query")
    blocks = max(1, -(-asked.count() // block))
    found = None
    for k in range(blocks):
        some = F.broadcast(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k))
        pairs = cells.join(some, ["scope", "term"]).where("query <> found").groupBy("scope", "cell", "found", "query").agg(F.count("*").alias("shared"))
        # The best of a cell first: pairs leave a task only as far as they can be among the best of all.
        best = _placed(pairs, ["scope", "cell", "query"]).where(F.col("place") <= most).select("query", "found", "shared")
        found = best if found is None else found.unionByName(best)
    return _placed(found, ["query"]).where(F.col("place") <= most).select("query", "found", "shared", "place")


def _placed(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("shared"), "found")).cast("long"))
