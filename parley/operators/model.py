"""The model boundary: an injected callable over batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.operators.graph import checkpointed
from parley.operators.ordered import Rule, ordered_groups


def apply_model(rows: DataFrame, model: Callable[[list[str]], list[int]]) -> DataFrame:
    """rows (chat_id, pos, content) with ``answer`` in place of the content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["chat_id", "pos"]].assign(answer=model(frame["content"].fillna("").tolist()))

    return rows.mapInPandas(run, "chat_id long, pos long, answer long")


def apply_pair_model(pairs: DataFrame, keys: list[str], model: Callable[[list[tuple[str, str]]], list[str]]) -> DataFrame:
    """``keys`` of pairs (left, right) with ``answer``, what the callable says of the two texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[keys].assign(answer=model(list(zip(frame["left"].fillna(""), frame["right"].fillna("")))))

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "left", "right").mapInPandas(run, f"{schema}, answer string")


def draws(packets: DataFrame, model: Callable[[list[str], list[int]], list[str]], seeds: list[int]) -> DataFrame:
    """packet, seed, no, title, importance, refs of what each seeded draw finds in each packet (packet, body, handles).

    The model is given bodies and seeds and answers in JSON: a list of findings {title, importance, refs}. An answer
    that is none is no finding; refs that the packet doesn't have go, and so does a finding whose refs all go."""
    schema = "array<struct<title: string, importance: bigint, refs: array<string>>>"
    asked = packets.select("packet", "body", "handles", F.explode(F.array(*map(F.lit, seeds)).cast("array<bigint>")).alias("seed"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["packet", "seed", "handles"]].assign(answer=model(frame["body"].fillna("").tolist(), frame["seed"].tolist()))

    kind = packets.schema["packet"].dataType.simpleString()
    told = asked.mapInPandas(run, f"packet {kind}, seed long, handles array<string>, answer string")
    found = told.select("packet", "seed", "handles", F.posexplode(F.from_json("answer", schema)).alias("no", "f"))
    bound = found.select("packet", "seed", F.col("no").cast("long").alias("no"), "f.title", "f.importance", F.array_sort(F.array_intersect("f.refs", "handles")).alias("refs"))
    return bound.where("size(refs) > 0")


#: Half of the smaller set of references, rounded down, but one at least.
SAME_STORY = Rule(lambda f: (f.shared >= 1) & (2 * f.shared + 1 >= f.least(f.n, f.m)))


def merged_draws(findings: DataFrame) -> DataFrame:
    """packet, first_seed, first_no, support (draws that found it), findings, title and importance of the best wording, refs
    of all: findings in order of packet, draw and number, each joined to the first story that it shares enough
    references with."""
    placed = checkpointed(findings.orderBy("packet", "seed", "no").withColumn("pos", F.monotonically_increasing_id()))
    # References of two packets are never the same, so each packet is decided on its own.
    keyed = placed.withColumns({"keys": F.transform("refs", lambda r: F.xxhash64(F.col("packet").cast("string"), r)), "part": F.min("pos").over(Window.partitionBy("packet"))})
    groups = ordered_groups(keyed.select("pos", F.col("keys").alias("refs"), "part"), SAME_STORY)
    rows = groups.join(placed, "pos")
    best = F.max_by(F.struct("title", "importance"), F.struct(F.size("refs"), "importance", -F.col("pos")))
    found = rows.groupBy("packet", "group_id").agg(
        F.min(F.struct("seed", "no")).alias("first"), F.countDistinct("seed").alias("support"), F.count("*").alias("findings"), best.alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"))
    return found.select("packet", F.col("first.seed").alias("first_seed"), F.col("first.no").alias("first_no"), "support", "findings", "best.title", "best.importance", "refs")
