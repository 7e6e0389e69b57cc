"""Selections that depend on what was taken before. Each runs over candidates that were reduced to
a bounded number by Spark, or within scopes by grouped pandas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.graph import checkpointed
from parley.operators.segments import scan


def greedy_cover(pages: DataFrame, k: int) -> list[int]:
    """Up to ``k`` pages (page, labels) that cover labels: the rarest uncovered label first, and of its pages the
    one with most new labels, smaller id first. Two small results a step come to the driver; labels and
    pages stay in Spark."""
    pages = checkpointed(pages)
    counts = checkpointed(pages.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")))
    chosen: list[int] = []
    covered: set[str] = set()
    while len(chosen) < k:
        label = counts.where(~F.col("label").isin(list(covered))).orderBy("n", "label").first()
        if label is None:
            break
        left = pages.where(F.array_contains("labels", label["label"]) & ~F.col("page").isin(chosen))
        known = F.array(*map(F.lit, sorted(covered))).cast("array<string>")
        best = left.orderBy(F.desc(F.size(F.array_except("labels", known))), "page").first()
        if best is None:
            covered.add(label["label"])
            continue
        chosen.append(int(best["page"]))
        covered |= set(best["labels"])
    return chosen


def fill_batches(slices: DataFrame, most: int) -> DataFrame:
    """scope, chat_id, batch: slices (scope, chat_id, n) in order into batches of ``most``; a slice
    stays whole if it fits into one. Slices pass sorted in Arrow batches; the state is two numbers."""

    def step(state: dict, row) -> dict:
        left = int(row.n)
        if state["held"] and state["held"] + min(left, most) > most:
            state["batch"], state["held"] = state["batch"] + 1, 0
        out = {"scope": row.scope, "chat_id": row.chat_id, "batch": state["batch"], "n": left}
        filled = state["held"] + left
        state["batch"], state["held"] = state["batch"] + filled // most, filled % most
        return out

    return scan(slices, "scope", ["chat_id"], step, "scope long, chat_id long, batch long, n long", lambda: {"batch": 0, "held": 0})


def complete_link(rows: DataFrame, reach: int) -> DataFrame:
    """id, cluster: a row joins the first cluster where it is linked with every member, else it starts
    one. ``rows``: scope, pos, id, linked (ids of earlier rows at most ``reach`` places back). A scope's
    rows come sorted and pass in batches: a cluster whose last member is out of reach is closed, so
    the state is a few rows, whatever the scope's size."""
    ordered = rows.select("scope", "pos", "id", "linked").repartition("scope").sortWithinPartitions("scope", "pos")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, live = None, []  # live: (last place, members)
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.scope != scope:
                    scope, live = r.scope, []
                live = [c for c in live if c[0] >= r.pos - reach]
                near = set(r.linked) if r.linked is not None else set()
                home = next((c for c in live if near.issuperset(c[1])), None)
                if home is None:
                    home = [r.pos, []]
                    live.append(home)
                home[0] = r.pos
                home[1].append(r.id)
                out.append((r.id, home[1][0]))
            yield pd.DataFrame(out, columns=["id", "cluster"])

    return ordered.mapInPandas(run, "id long, cluster long")


def rounds(rows: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """Adds ``round``: the place of a row within its scope, for drawing from scopes in turn."""
    from pyspark.sql.window import Window as W

    return rows.withColumn("round", F.row_number().over(W.partitionBy(scope).orderBy(*order)).cast("long"))


def guarded_sample(candidates: pd.DataFrame, k: int, most: float) -> list[int]:
    """Ids in the given order whose terms' Jaccard with every accepted one is at most ``most``."""
    return [i for i, _ in _accepted([], candidates, k, most)]


def _accepted(chosen: list[tuple[int, set]], candidates: pd.DataFrame, k: int, most: float) -> list[tuple[int, set]]:
    for r in candidates.itertuples():
        if len(chosen) == k:
            break
        terms = set(r.terms)
        if all(len(terms & t) <= most * len(terms | t) for _, t in chosen):
            chosen.append((int(r.id), terms))
    return chosen


def guarded_draw(rows: DataFrame, scope: str, order: list[str], k: int, most: float, block: int) -> list[int]:
    """guarded_sample over all rows (id, scope, terms, order), drawn from the scopes in turn. Blocks of the
    draw come to the driver; rows alike to accepted ones leave in Spark, so the first row of every
    later block is accepted and there are at most ``k`` of them."""
    from pyspark.sql.window import Window as W

    rows = rows.withColumn(scope, F.coalesce(scope, F.lit("")))
    part = F.row_number().over(W.partitionBy(scope, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order))
    first = rounds(rows.withColumn("p", part).where(F.col("p") <= block), scope, order)
    drawn = first.orderBy("round", scope).limit(block).toPandas()
    chosen = _accepted([], drawn, k, most)
    every = None
    while len(chosen) < k and len(drawn) == block:
        every = checkpointed(rounds(rows, scope, order)) if every is None else every
        last = drawn.iloc[-1]
        later = every.where((F.col("round") > int(last["round"])) | ((F.col("round") == int(last["round"])) & (F.col(scope) > last[scope])))
        sets = F.broadcast(rows.sparkSession.createDataFrame([([sorted(t) for _, t in chosen],)], "sets array<array<string>>"))
        unlike = F.forall("sets", lambda t: F.size(F.array_intersect("terms", t)) <= most * F.size(F.array_union("terms", t)))
        drawn = later.crossJoin(sets).where(unlike).drop("sets").orderBy("round", scope).limit(block).toPandas()
        chosen = _accepted(chosen, drawn, k, most)
    return [i for i, _ in chosen]


def best_of_kind(packages: DataFrame, budget: int) -> DataFrame:
    """The packages (id, score, labels, scope) that ``budgeted`` can choose: those of one scope and label
    set gain alike, so the best ``budget`` of each. Salted parts come first."""
    from pyspark.sql.window import Window as W

    kind = ["scope", F.array_sort("labels")]
    best = lambda *by: F.row_number().over(W.partitionBy(*kind, *by).orderBy(F.desc("score"), "id"))
    parts = packages.withColumn("p", best(F.pmod(F.xxhash64("id"), F.lit(64)))).where(F.col("p") <= budget)
    return parts.withColumn("p", best()).where(F.col("p") <= budget).drop("p")


def budgeted(candidates: pd.DataFrame, budget: int, gain: int = 20, again: int = 15) -> list[int]:
    """Up to ``budget`` ids by score, plus ``gain`` for every label not covered yet, less ``again``
    for each package of the same scope chosen before; smaller id first."""
    left = {int(r.id): (int(r.score), set(r.labels), r.scope) for r in candidates.itertuples()}
    chosen: list[int] = []
    covered: set = set()
    scopes: dict = {}
    while left and len(chosen) < budget:
        best = min(left, key=lambda i: (-(left[i][0] + gain * len(left[i][1] - covered) - again * scopes.get(left[i][2], 0)), i))
        _, labels, scope = left.pop(best)
        chosen.append(best)
        covered |= labels
        scopes[scope] = scopes.get(scope, 0) + 1
    return chosen
