"""Periodic runs of words by string synchronising sets.

A run is a stretch of words [b, e) with smallest period q and e - b >= 2q that no neighbouring
word extends keeping q. Texts are worked on as one array of word numbers, a separator of its own
behind each text, so no run crosses texts.

* Periods up to ``SMALL`` come from comparing the array with itself, q places on.
* At each scale t = 2, 4, 8, ... the synchronising set has the positions i where the least hash of
  the fragments of t words that start in [i, i + t] stands at i or at i + t. Fragments of a period
  of at most t/3 take no part. Positions with equal contexts of 2t words that lie 3t-1 to 6t-2
  apart propose this distance as a period; runs of such periods hold two such positions.
* The exception is a run whose first q words have a period p <= t/3. Then two maximal regions of
  period p meet in it. The regions are those found at smaller scales, and for each pair that meets
  the distances at which their phases agree are proposed.

Each proposal is extended word by word, which proves it, so hashes decide only where to look;
equal fragments have equal hashes, and nothing is lost by a collision.

Defined cases: a null or empty text, or one without a word, has no run and an empty collapsed
text. Repeated rows are worked on each. A text of any length is worked on whole, in memory that
grows with its number of words alone. Only ``doc_id`` and ``text`` are read, whatever else the
table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import chunks

#: Least length of a run that counts.
LEAST = 12
#: Periods that are found by comparison alone.
SMALL = 4
NEVER = np.uint64(2**64 - 1)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)

SCHEMA = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of fragments that consist of two parts."""
    return mixed(left * ODD[0] + (right ^ (right >> np.uint64(17))) * ODD[2])


def common(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j > i on, rightwards (step 1) or leftwards (-1), are equal."""
    total, size = 0, 32
    while True:
        room = min(size, len(words) - j if step > 0 else i + 1)
        if room <= 0:
            return total
        a, b = (words[i : i + room], words[j : j + room]) if step > 0 else (words[i - room + 1 : i + 1][::-1], words[j - room + 1 : j + 1][::-1])
        differ = a != b
        k = int(differ.argmax())
        if differ[k]:
            return total + k
        total, i, j, size = total + room, i + step * room, j + step * room, min(size * 2, 1 << 20)


class Finder:
    """Runs of an array of word numbers whose separators occur once each."""

    def __init__(self, words: np.ndarray, longest: int):
        self.words, self.longest = words, longest
        self.by_period: dict[int, list[tuple[int, int]]] = {}
        self.seen: set[tuple[int, int]] = set()

    def keep(self, b: int, e: int, q: int) -> None:
        """A stretch that has a smaller period is known already, by the same ends."""
        if (b, e) not in self.seen:
            self.seen.add((b, e))
            self.by_period.setdefault(q, []).append((b, e))

    def compare(self, q: int) -> None:
        """All stretches of at least three periods q."""
        if len(self.words) <= q:
            return
        equal = np.zeros(len(self.words) - q + 2, bool)
        equal[1:-1] = self.words[:-q] == self.words[q:]
        turns = np.flatnonzero(equal[1:] != equal[:-1])
        starts, ends = turns[::2], turns[1::2]
        for b, e in zip(starts[ends - starts >= 2 * q].tolist(), ends[ends - starts >= 2 * q].tolist()):
            self.keep(b, e + q, q)

    def extend(self, positions: np.ndarray, periods: np.ndarray) -> None:
        """Proposals (position, period), periods ascending; one within a stretch that was looked at is passed over."""
        order = np.lexsort((positions, periods))
        positions, periods = positions[order], periods[order]
        bounds = np.flatnonzero(np.diff(periods, prepend=-1, append=-1))
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            q, at = int(periods[first]), positions[first:last]
            k = 0
            while k < len(at):
                s = int(at[k])
                b = s - common(self.words, s - 1, s - 1 + q, -1) if s else s
                e = s + q + common(self.words, s, s + q, 1)
                if e - b >= max(LEAST, 2 * q):
                    self.keep(b, e, q)
                k = max(k + 1, int(np.searchsorted(at, e - q)))

    def periodic_starts(self, t: int, size: int) -> np.ndarray:
        """Where the fragment of t words has a period of at most t/3."""
        change = np.zeros(size + 1, np.int32)
        for p in range(1, t // 3 + 1):
            for b, e in self.by_period.get(p, ()):
                if e - b >= t:
                    change[b] += 1
                    change[e - t + 1] -= 1
        return np.cumsum(change[:-1]) > 0

    def meeting_regions(self, t: int, low: int, high: int) -> list[tuple[int, int]]:
        """Proposals from pairs of regions of one small period that meet."""
        found = []
        for p in range(2, t // 3 + 1):
            regions = sorted(x for x in self.by_period.get(p, ()) if x[1] - x[0] >= low)
            for (x1, y1), (x2, y2) in zip(regions, regions[1:]):
                if x2 > y1:
                    continue
                root = self.words[x2 : x2 + p]
                turn = next((r for r in range(p) if np.array_equal(self.words[x1 + r : x1 + r + p], root)), None)
                if turn is not None:
                    first = low + (x2 - x1 - turn - low) % p
                    found += [(y1 - q, q) for q in range(first, min(high, min(y1 - x1, y2 - x2) + 1), p)]
        return found

    def scale(self, t: int, fragments: np.ndarray, contexts: np.ndarray) -> None:
        """Periods of 3t-1 to 6t-2 words; fragments and contexts are hashes of t and 2t words."""
        low, high = 3 * t - 1, 6 * t - 1
        ids = fragments.copy()
        ids[self.periodic_starts(t, len(ids))] = NEVER
        least, step = ids, 1
        while step < t:
            least, step = np.minimum(least[:-step], least[step:]), step * 2
        least = np.minimum(least[:-1], least[1:])
        chosen = np.flatnonzero(((least == ids[: len(least)]) | (least == ids[t : t + len(least)])) & (least != NEVER))
        chosen = chosen[chosen < len(contexts)]
        order = np.argsort(contexts[chosen], kind="stable")
        at, key = chosen[order], contexts[chosen][order]
        positions, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        live = np.arange(len(at) - 1)
        for lag in range(1, len(at)):
            live = live[live < len(at) - lag]
            distance = at[live + lag] - at[live]
            near = (key[live + lag] == key[live]) & (distance < high)
            live, distance = live[near], distance[near]
            if not len(live):
                break
            positions.append(at[live][distance >= low])
            periods.append(distance[distance >= low])
        met = self.meeting_regions(t, low, high)
        self.extend(
            np.concatenate(positions + [np.array([s for s, _ in met], np.int64)]), np.concatenate(periods + [np.array([q for _, q in met], np.int64)])
        )

    def run(self) -> np.ndarray:
        """Rows (start, end, period)."""
        for q in range(1, SMALL + 1):
            self.compare(q)
        t, h = 2, mixed(self.words.view(np.uint64) * ODD[0] + ODD[2])
        h = joined(h[:-1], h[1:])
        while 3 * t - 1 <= self.longest // 2:
            contexts = joined(h[:-t], h[t:])
            self.scale(t, h, contexts)
            t, h = t * 2, contexts
        found = [(b, e, q) for q, runs in self.by_period.items() for b, e in runs if e - b >= max(LEAST, 2 * q)]
        return np.array(sorted(found), np.int64).reshape(-1, 3)


def runs_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, end, period) of all texts in one numbering of words, and where each text starts in it."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    longest = int(lengths.max(initial=0))
    words = -1 - np.arange(starts[-1] + 2 * longest, dtype=np.int64)  # separators, and as many beyond the end as a context is long
    known: dict[bytes, int] = {}
    for text, start in zip(texts, starts.tolist()):
        words[start : start + len(text)] = [known.setdefault(w, len(known)) for w in text]
    return Finder(words, longest).run(), starts


def worked(texts: list[list[bytes]]) -> Iterator[tuple[list[dict], bytes]]:
    """Runs and collapsed text of each text."""
    runs, starts = runs_of(texts)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, text in enumerate(texts):
        own = (runs[bounds[k] : bounds[k + 1]] - [starts[k], starts[k], 0]).tolist()
        if own:
            change = np.zeros(len(text) + 1, np.int32)
            for b, e, q in own:
                change[b + q] += 1
                change[e] -= 1
            text = [w for w, hit in zip(text, (np.cumsum(change[:-1]) > 0).tolist()) if not hit]
        yield [{"start": b, "length": e - b, "period": q} for b, e, q in own], b" ".join(text)


def _worked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for part in chunks(batch):
            texts = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]  # bytes split at the six ASCII spaces
            done = list(worked(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([r for r, _ in done], runs_type), pa.array([c for _, c in done], pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"]
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, all runs of the text by start and period, and the text without what a run repeats.

    A word goes if a run contains it after that run's first period; kept words are joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_worked_batches, SCHEMA.replace("doc_id bigint", f"doc_id {kind}", 1))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of each tenth text (by crc32 of doc_id) repeat from a place on.

    A row without doc_id keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("w"))
    placed = words.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def place(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")

    tail = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return placed.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(tail).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of what ``periodic_runs`` found."""
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    best = F.when(F.size("runs") > 0, longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.l div best.period").cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
