"""Scans with state: in batch by grouped pandas, over streams by applyInPandasWithState."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _last_replies(us: np.ndarray, wants: np.ndarray, last: int | None, cooldown: int) -> tuple[np.ndarray, int | None]:
    """Which of the ordered candidates reply; only candidates beyond the last reply's cooldown do."""
    replies = np.zeros(len(us), bool)
    at = 0
    places = np.flatnonzero(wants)
    times = us[places]
    while True:
        at = int(np.searchsorted(times, last + cooldown)) if last is not None else at
        if at >= len(places):
            return replies, last
        replies[places[at]] = True
        last = int(times[at])


def cooldown_decisions(messages: DataFrame, candidate: Column, cooldown_us: int, scope: str = "chat_id", keep: list[str] | None = None) -> DataFrame:
    """row_id (and ``keep``), decision: reply, cooldown or no_match. Rows of a chat come sorted from Spark and pass
    in Arrow batches; what is kept between batches is one time a chat, so a chat of any size fits."""
    kept = keep or []
    rows = messages.select(*dict.fromkeys([scope, "us", "row_id", *kept]), candidate.alias("wants")).repartition(scope).sortWithinPartitions(scope, "us", "row_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, last = None, None
        for frame in frames:
            out = []
            for key, part in frame.groupby(scope, sort=False, dropna=False):
                last = last if key == chat else None
                replies, last = _last_replies(part["us"].to_numpy(), part["wants"].to_numpy(bool), last, cooldown_us)
                chat = key
                out.append(pd.DataFrame({**{c: part[c] for c in kept}, "row_id": part["row_id"], "decision": np.where(replies, "reply", np.where(part["wants"], "cooldown", "no_match"))}))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(run, ", ".join([f"{c} {messages.schema[c].dataType.simpleString()}" for c in kept] + ["row_id long", "decision string"]))


def streaming_sessions(stream: DataFrame, gap: str = "45 minutes", late: str = "1 hour") -> DataFrame:
    """Session counts of a message stream with event-time watermark; a gap equal to the limit splits
    here, as session windows are half-open."""
    return stream.withWatermark("ts", late).groupBy("chat_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("chat_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def task_machine(stream: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Task states over a stream of (task_id, kind): pending, succeeded, failed, with retries."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, status = state.get if state.exists else (0, "pending")
        for frame in frames:
            for kind in frame.sort_values("seq")["kind"]:
                if kind == "retry" and status == "failed":
                    attempts, status = 0, "pending"
                elif kind in ("ok", "error") and status == "pending":
                    attempts += 1
                    status = "succeeded" if kind == "ok" else "failed" if attempts >= max_attempts else "pending"
        state.update((attempts, status))
        yield pd.DataFrame({"task_id": [key[0]], "attempts": [attempts], "status": [status]})

    return stream.groupBy("task_id").applyInPandasWithState(step, "task_id long, attempts long, status string", "attempts long, status string", "update", GroupStateTimeout.NoTimeout)
