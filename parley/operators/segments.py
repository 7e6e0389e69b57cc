"""Segmentation with state that a window can't carry: the current block's vocabulary, strands, bundles.
A scope's rows come sorted from Spark and pass in Arrow batches; the state between rows is a few
recent sets, so a scope of any size fits in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a partition of ``bundle_scales``, some 100 bytes each while they are counted.
PART_ROWS = 50_000


def scan(rows: DataFrame, scope: str, order: list[str], step: Callable[[dict, object], dict], fields: str, fresh: Callable[[], dict]) -> DataFrame:
    """Runs ``step(state, row) -> output columns`` over each scope in order."""
    ordered = rows.repartition(scope).sortWithinPartitions(scope, *order)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), fresh()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if getattr(row, scope) != at:
                    at, state = getattr(row, scope), fresh()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, fields)


def conversation_blocks(rows: DataFrame, gap_us: int) -> DataFrame:
    """chat_id, row_id, block: a new block at a long gap, or where a row shares no term with the union
    of the block's last four signatures. ``rows``: chat_id, us, row_id, terms."""

    def step(state: dict, row) -> dict:
        terms = set(row.terms)
        known = set().union(*state["recent"]) if state["recent"] else set()
        if state["us"] is None or row.us - state["us"] > gap_us or (terms and known and not terms & known):
            state["block"] += 1
            state["recent"] = []
        state["us"] = row.us
        state["recent"] = [*state["recent"], terms][-4:]
        return {"chat_id": row.chat_id, "row_id": row.row_id, "block": state["block"]}

    return scan(rows, "chat_id", ["us", "row_id"], step, "chat_id long, row_id long, block long", lambda: {"us": None, "block": -1, "recent": []})


def parallel_strands(rows: DataFrame, most: int = 4) -> DataFrame:
    """chat_id, row_id, strand: a row goes to the open strand it shares most terms with, the latest of
    equals, or opens one; only the ``most`` latest stay open."""

    def step(state: dict, row) -> dict:
        terms = set(row.terms)
        best = max(state["open"], key=lambda s: (len(s[1] & terms), s[2]), default=None)
        if best is None or (terms and not best[1] & terms):
            best = [state["next"], set(), 0]
            state["next"] += 1
            state["open"].append(best)
        best[1], best[2] = terms or best[1], row.row_id
        state["open"] = sorted(state["open"], key=lambda s: s[2])[-most:]
        return {"chat_id": row.chat_id, "row_id": row.row_id, "strand": best[0]}

    return scan(rows, "chat_id", ["us", "row_id"], step, "chat_id long, row_id long, strand long", lambda: {"open": [], "next": 0})


def dialogue_bundles(rows: DataFrame, window: int, span_us: int) -> DataFrame:
    """chat_id, row_id, bundle: local bundles. A row joins the newest open bundle whose last row it
    relates to (shared term) without a conflicting object; bundles close after ``window`` rows or
    ``span_us``. ``rows``: chat_id, us, row_id, terms, object."""

    def step(state: dict, row) -> dict:
        state["n"] += 1
        state["open"] = [b for b in state["open"] if state["n"] - b["n"] <= window and row.us - b["us"] <= span_us]
        terms, known = set(row.terms), None if row.object is None or row.object != row.object else row.object  # a null number arrives as NaN
        home = next((b for b in reversed(state["open"]) if b["terms"] & terms and (b["object"] is None or known is None or b["object"] == known)), None)
        if home is None:
            home = {"id": row.row_id, "object": None}
            state["open"].append(home)
        home.update(n=state["n"], us=row.us, terms=terms, object=home["object"] if known is None else known)
        return {"chat_id": row.chat_id, "row_id": row.row_id, "bundle": home["id"]}

    return scan(rows, "chat_id", ["us", "row_id"], step, "chat_id long, row_id long, bundle long", lambda: {"open": [], "n": 0})


def bundle_parents(rows: DataFrame, most: int) -> DataFrame:
    """chat_id, row_id, bundle, candidate_rank: a row joins every open bundle whose last row it shares a
    term with and no object contradicts, the first ``most`` of them, and only these stay open. A row
    without such a bundle opens one and keeps the others open behind it, ``most`` in all. A bundle is
    named by its first row. ``rows``: chat_id, us, row_id, terms, object; null terms match nothing."""

    def step(state: dict, row) -> dict:
        terms = {t for t in row.terms if t is not None} if row.terms is not None else set()
        known = None if row.object is None or row.object != row.object else row.object  # a null number arrives as NaN
        fit = [b[0] for b in state["open"] if b[1] & terms and (b[2] is None or known is None or b[2] == known)][:most]
        if fit:
            state["open"] = [(b, terms, known) for b in fit]
        else:
            fit = [row.row_id]
            state["open"] = [(row.row_id, terms, known), *state["open"]][:most]
        return {"chat_id": row.chat_id, "row_id": row.row_id, "bundles": fit}

    joined = scan(rows, "chat_id", ["us", "row_id"], step, "chat_id long, row_id long, bundles array<long>", lambda: {"open": []})
    return joined.select("chat_id", "row_id", F.posexplode("bundles").alias("candidate_rank", "bundle"))


def bundle_scales(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """scale, chat_id, message_id, fragments, first_fragment, last_fragment. Scales: micro (a fragment),
    turn (a message's fragments), session (a chat's; no message_id), and for cold fragments a sparse and
    a cold bundle each. ``rows``: chat_id, message_id, fragment, cold. A repeated fragment is one, cold if
    any of its rows is; a null ``cold`` is false. Sessions add up turns, so a chat of any size is combined
    before it is shuffled. Messages lie in partitions of about ``part_rows`` rows, so what a task holds of them
    doesn't follow the input."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // part_rows))
    rows = rows.repartition(parts, "chat_id", "message_id")
    rows = rows.groupBy("chat_id", "message_id", "fragment").agg(F.bool_or("cold").alias("cold"))
    one = F.array(F.lit("micro"), F.when(F.col("cold"), "sparse"), F.when(F.col("cold"), "cold"))
    single = rows.select(F.explode(F.array_compact(one)).alias("scale"), "chat_id", "message_id", F.lit(1).cast("long").alias("fragments"), F.col("fragment").alias("first_fragment"), F.col("fragment").alias("last_fragment"))
    turns = rows.groupBy("chat_id", "message_id").agg(F.count("*").alias("fragments"), F.min("fragment").alias("first_fragment"), F.max("fragment").alias("last_fragment"))
    sessions = turns.groupBy("chat_id").agg(F.sum("fragments").alias("fragments"), F.min("first_fragment").alias("first_fragment"), F.max("last_fragment").alias("last_fragment"))
    return single.unionByName(turns.withColumn("scale", F.lit("turn"))).unionByName(sessions.withColumn("scale", F.lit("session")), allowMissingColumns=True)
