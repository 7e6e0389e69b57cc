"""Connected components over edges tables, with lineage cut in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: References, and edges, that a task holds at a time: some 40 MB, and 80 MB where no two edges share an end.
HELD, EDGES = 200_000, 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of our own is made
    only where the session names none and runs in this machine alone (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="parley-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def in_blocks(run: Callable[[list, list], Iterable[pa.RecordBatch]], size: int) -> Callable:
    """A step over Arrow batches of two columns that hands on their values in blocks of ``size`` rows or a batch more."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            if len(a) >= size:
                yield from run(a, b)
                a, b = [], []
        yield from run(a, b)

    return step


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """id, root within a block of edges: roots take the least root that they meet until none meets another."""
    ends = pa.array(np.concatenate([a, b])).dictionary_encode()
    ids = ends.dictionary.to_numpy()
    order = np.argsort(ids)
    root, ids, place = np.arange(len(ids)), ids[order], np.empty(len(ids), np.int64)
    place[order] = root
    a, b = np.split(place[ends.indices.to_numpy()], 2)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        a, b = low[low < high], high[low < high]
        np.minimum.at(root, b, a)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return ids, ids[root]


def _forests(held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, root of blocks of ``held`` edges or a batch more. A block begins with what the last one found, unless that
    is more than half a block."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
            parts.append(tuple(c.to_numpy() for c in batch.columns))
            n += batch.num_rows
            if n >= held:
                found = _joined(*map(np.concatenate, zip(*parts)))
                parts, n = [found], len(found[0])
                if 2 * n > held:
                    yield rows(*found)
                    parts, n = [], 0
        if n:
            yield rows(*_joined(*map(np.concatenate, zip(*parts))))

    def rows(ids: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["id", "root"])

    return step


def components(edges: DataFrame, held: int = EDGES) -> DataFrame:
    """id, root (the smallest id reachable) of every id that edges (a, b) name. Tasks join what their blocks of edges
    link, so only roots that stand for one id in two blocks are left to rounds over tables: none where edges of a
    component lie together."""
    own = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    near = checkpointed(own.mapInArrow(_forests(held), "id long, root long"))
    first = near.groupBy("id").agg(F.min("root").alias("root"), F.max("root").alias("last"))
    first = checkpointed(first)
    met = first.where("root < last").select("id", F.col("root").alias("b"))
    if not met.limit(1).count():
        return first.select("id", "root")
    far = _rounds(near.join(met, "id").where("root <> b").select(F.col("root").alias("a"), "b"))
    return first.join(far.select(F.col("id").alias("root"), F.col("root").alias("least")), "root", "left").select("id", F.coalesce("least", "root").alias("root"))


def _rounds(edges: DataFrame) -> DataFrame:
    """Components by minimum labels of neighbours, then a jump to the label's own label, until nothing moves."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("next"))
        after = checkpointed(step.join(jump, "new").select("id", F.least("new", "next").alias("root"), (F.least("new", "next") != F.col("old")).alias("moved")))
        labels = after.select("id", "root")
        if not after.where("moved").limit(1).count():
            return labels
