"""Contracts of datasets as data: rules of rows in one pass a table, of keys, references, spans and graphs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.graph import HELD, checkpointed, components, in_blocks


def counted(found: DataFrame, dataset: str, rule: str) -> DataFrame:
    return found.agg(F.count("*").alias("violations")).select(F.lit(dataset).alias("dataset"), F.lit(rule).alias("rule"), "violations")


def row_rules(rows: DataFrame, dataset: str, rules: dict[str, str]) -> DataFrame:
    """How many rows each predicate holds for, all in one pass."""
    sums = rows.agg(*[F.count_if(F.expr(r)).alias(n) for n, r in rules.items()]).unpivot([], list(rules), "rule", "violations")
    return sums.select(F.lit(dataset).alias("dataset"), "rule", "violations")


def repeated(rows: DataFrame, dataset: str, rule: str, keys: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return counted(rows.groupBy(*keys).count().where("count > 1"), dataset, rule)


def dangling(rows: DataFrame, dataset: str, rule: str, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows that refer to none of the other table."""
    known = other.select(F.col(other_key).alias(key)).distinct()
    return counted(rows.where(F.col(key).isNotNull()).join(known, key, "left_anti"), dataset, rule)


def linked_apart(links: DataFrame, apart: DataFrame, dataset: str, rule: str) -> DataFrame:
    """Pairs (a, b) that must stay apart but are in one component of links (a, b)."""
    roots = components(links)
    a, b = (roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    return counted(apart.join(a, "a").join(b, "b").where("root_a = root_b"), dataset, rule)


def _followed(ids: list, refs: list) -> Iterator[pa.RecordBatch]:
    """id, ref of a block's ids that may stand on a cycle: ref is null for those on a cycle of the block, and the id's own
    where the chain leads out of the block. Chains that end inside, or in a cycle further on, are done."""
    to = dict(zip(ids, refs))
    end: dict = {}  # of each id followed: True on a cycle, False out of the block, None for no cycle
    for start in to:
        path, at = {}, start
        while at in to and at not in end and at not in path and to[at] is not None:
            path[at] = len(path)
            at = to[at]
        if at in path:
            found, ring = None, path[at]
        elif at in to:
            # What leads into a cycle is on none; what joins a chain that leads out leads out.
            found, ring = (False if end.get(at) is False else None), len(path)
            end.setdefault(at, None)
        else:
            found, ring = False, len(path)
        for x, i in path.items():
            end[x] = True if i >= ring else found
    out = [(x, None if e else to[x]) for x, e in end.items() if e is not None]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["id", "ref"])


def cycle_members(refs: DataFrame, held: int = HELD) -> DataFrame:
    """id of all that stand on a cycle of references (id, ref), one row and one reference an id at most.

    Tasks follow the chains in their blocks of rows. Only ids whose chains lead out of a block are left to rounds over
    tables: none where the ids of a chain lie together, with those that refer to nothing."""
    own = refs.select(F.col("id").cast("long"), F.col("ref").cast("long"))
    near = checkpointed(own.mapInArrow(in_blocks(_followed, held), "id long, ref long"))
    found, left = near.where("ref IS NULL").select("id"), near.where("ref IS NOT NULL")
    return found.union(_rounds(left)) if left.limit(1).count() else found


def _rounds(refs: DataFrame) -> DataFrame:
    """In rounds those go that nothing refers to, and those whose reference leads out; a pointer doubled in each
    round lets long chains go fast: an id is on a cycle exactly if it is among the ends of chains of any length."""
    now = checkpointed(refs.where("ref IS NOT NULL").select("id", "ref"))
    jump, left = now, now.count()
    while True:
        # Pointers of twice the length; what leads out of the references goes.
        jump = checkpointed(jump.join(jump.select(F.col("id").alias("ref"), F.col("ref").alias("next")), "ref").select("id", F.col("next").alias("ref")))
        ends = checkpointed(jump.select(F.col("ref").alias("id")).distinct())
        n = ends.count()
        if n == left:
            return ends
        left = n


def reference_cycles(refs: DataFrame, dataset: str, rule: str) -> DataFrame:
    return counted(cycle_members(refs), dataset, rule)


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
