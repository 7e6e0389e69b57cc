"""Several ordered streams into pages under one token budget, as a fold over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "struct<n0:int,n1:int,n2:int,tokens:bigint,status:string>"
STATE = f"struct<c0:int,c1:int,c2:int,pages:array<{PAGE}>>"
STREAMS = (0, 1, 2)


def _taken(sums: Column, at: Column, used: Column, cap: int, budget: int) -> Column:
    """How many items from ``at`` on fit, at most ``cap``. ``sums`` are running totals that begin with 0."""
    room = F.least(F.lit(cap), F.size(sums) - 1 - at)
    fits = F.size(F.filter(F.sequence(F.lit(1), F.greatest(room, F.lit(1))), lambda k: used + F.get(sums, at + k.cast("int")) - F.get(sums, at) <= budget))
    return F.when(room > 0, fits).otherwise(0)


def stream_pages(items: DataFrame, caps: tuple[int, int, int], budget: int) -> DataFrame:
    """root, page, n0, n1, n2, tokens, status: each page takes from stream 0 as many items as its cap and the budget
    allow, then from 1, then from 2, so a later stream fills what an earlier one leaves. An item that no
    page can hold has a page of its own, which is pending. ``items``: root, stream, pos, tokens.

    The items of a root are one array each stream, of numbers alone; texts stay where they are."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("stream") == k, F.struct("pos", F.col("tokens").cast("long").alias("tokens"))))) for k in STREAMS]
    rows = items.groupBy("root").agg(*[x.alias(f"s{k}") for k, x in zip(STREAMS, lists)], F.count("*").cast("int").alias("n"))
    running = lambda s: F.aggregate(s, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["tokens"])))
    rows = rows.select("root", "n", *[running(F.col(f"s{k}")).alias(f"p{k}") for k in STREAMS])

    def step(state: Column, _: Column) -> Column:
        at = [state[f"c{k}"] for k in STREAMS]
        took, used, blocked = [], F.lit(0).cast("long"), F.lit(False)
        for k in STREAMS:
            sums = F.col(f"p{k}")
            n = F.when(blocked, 0).otherwise(_taken(sums, at[k], used, caps[k], budget))
            # Nothing on the page yet and an item left that doesn't fit: it goes alone.
            alone = ~blocked & (sum(took, F.lit(0)) == 0) & (n == 0) & (at[k] < F.size(sums) - 1)
            n = F.when(alone, 1).otherwise(n).cast("int")
            used = used + F.get(sums, at[k] + n) - F.get(sums, at[k])
            took, blocked = [*took, n], blocked | alone
        page = F.struct(*[n.alias(f"n{k}") for k, n in zip(STREAMS, took)], used.alias("tokens"), F.when(blocked, "pending").otherwise("ready").alias("status"))
        after = F.struct(*[(c + n).cast("int").alias(f"c{k}") for k, c, n in zip(STREAMS, at, took)], F.concat(state["pages"], F.array(page.cast(PAGE))).alias("pages"))
        return F.when(sum(took, F.lit(0)) == 0, state).otherwise(after.cast(STATE))

    start = F.struct(*[F.lit(0).alias(f"c{k}") for k in STREAMS], F.array().cast(f"array<{PAGE}>").alias("pages")).cast(STATE)
    pages = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step)["pages"]
    found = rows.select("root", F.posexplode(pages).alias("page", "p"))
    return found.select("root", F.col("page").cast("long").alias("page"), *[F.col(f"p.n{k}").alias(f"n{k}") for k in STREAMS], "p.tokens", "p.status")
