"""Mentions with exact spans: non-overlapping longest matches of typed rules and of a dictionary.

``typed_mentions`` reads each text once: rules find times, quantities, addresses and numbers, a trie of
words finds dictionary entries of one word or more, and of what begins at one place the longest wins.
Clauses end at sentence marks that stand inside no mention. ``claims`` builds on these mentions: one
claim for each clause that does something.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mentions that a task holds before it sends them on.
HELD = 20_000
#: Rules by type for the test texts; a profile may bring others.
RULES = {"number": r"[0-9]{3,}", "mail": r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9.-]{1,128}", "caps": r"[A-Z]{3,}", "name": r"[A-Z][a-z]{5,}"}


def mentions(rows: DataFrame, id_column: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """id, type, start, end, surface: at each place the longest match, then on behind it."""
    known = [(name, re.compile(p)) for name, p in (rules or RULES).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):  # a text at a time, and no more mentions than ``HELD`` at once
                i, t = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or ""
                last = 0
                for s, e, n in sorted((m.start(), -m.end(), n) for n, p in known for m in p.finditer(t)):
                    if s >= last:
                        out.append((i, n, s, -e, t[s:-e]))
                        last = -e
                        if len(out) >= HELD:
                            yield _spans(out)
                            out = []
            if out:
                yield _spans(out)

    kind = "id long, type string, start long, end long, surface string"
    return rows.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(run, kind)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "type", "start", "end", "surface"])


#: Typed rules that may hold sentence marks, the first one first where two are equally long.
VALUES = {
    "mail": re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    "address": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "time": re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2})?|[0-9]{1,2}:[0-9]{2}"),
    "quantity": re.compile(r"[0-9]+(?:[.,][0-9]+)? ?(?:%|kg|km|GB|MB|ms|EUR|USD)"),
    "number": re.compile(r"[0-9]{3,}"),
}
WORD = re.compile(r"\w+")
MARKS = re.compile(r"[.!?\n]+")
END = ""  # a key that no word has: the class of an entry that ends there


def trie(entries: list[tuple[str, str]]) -> dict:
    """Entries (words with a space between, class) by their words."""
    root: dict = {}
    for phrase, name in entries:
        at = root
        for word in phrase.lower().split():
            at = at.setdefault(word, {})
        at[END] = name
    return root


def value_of(kind: str, surface: str) -> str:
    """Normal form: ISO times, a quantity as number and unit, all else in lower case."""
    if kind == "time":
        return surface.replace(" ", "T") if "-" in surface else surface.zfill(5)
    if kind == "quantity":
        m = re.match(r"([0-9]+)(?:[.,]([0-9]+))? ?(.*)", surface)
        return f"{m[1]}.{m[2]} {m[3]}" if m[2] else f"{m[1]} {m[3]}"
    return surface.lower()


def found_in(text: str, known: dict) -> list[tuple[int, str, int, int, str]]:
    """(clause, type, start, end, value) of a text, by start. Words in neither a value nor the dictionary are
    names if they begin with a capital inside a clause, and the longest word of a clause stands in as
    ``noun`` where it has no name."""
    spans = sorted((m.start(), -m.end(), i, kind) for i, (kind, p) in enumerate(VALUES.items()) for m in p.finditer(text))
    values, last = [], 0
    for s, e, _, kind in spans:
        if s >= last:
            values.append((s, -e, kind))
            last = -e
    inside = {s: e for s, e, _ in values}
    starts = [s for s, _, _ in values]
    covered = lambda a: (i := bisect.bisect_right(starts, a)) > 0 and inside[starts[i - 1]] > a
    ends = [m.start() for m in MARKS.finditer(text) if not all(covered(x) for x in range(m.start(), m.end()))]
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text) if not covered(m.start())]
    clause = lambda a: bisect.bisect_right(ends, a)
    out = [(clause(s), kind, s, e, value_of(kind, text[s:e])) for s, e, kind in values]
    i, firsts, nouns, named = 0, set(), {}, set()
    while i < len(words):
        s, e, word = words[i]
        c = clause(s)
        at, j, hit = known, i, None
        while j < len(words) and (j == i or (clause(words[j][0]) == c and text[words[j - 1][1] : words[j][0]].isspace())):
            at = at.get(words[j][2].lower())
            if at is None:
                break
            j += 1
            if END in at:
                hit = (j, at[END])
        first = c not in firsts
        firsts.add(c)
        if hit:
            out.append((c, hit[1], s, words[hit[0] - 1][1], text[s : words[hit[0] - 1][1]].lower()))
            i = hit[0]
            continue
        if not first and len(word) >= 6 and word[0].isupper() and word[1:].islower() and word.isalpha():
            out.append((c, "name", s, e, word.lower()))
            named.add(c)
        if word.isalpha() and len(word) >= 4 and (c not in nouns or len(word) > nouns[c][1] - nouns[c][0]):
            nouns[c] = (s, e)
        i += 1
    out += [(c, "noun", s, e, text[s:e].lower()) for c, (s, e) in nouns.items() if c not in named]
    return sorted(out, key=lambda x: (x[2], x[3], x[1]))


def typed_mentions(rows: DataFrame, id_column: str, text: str, entries: list[tuple[str, str]]) -> DataFrame:
    """id, clause, type, start, end, value of every text. The entries go to every task: a profile of some hundred
    words, as a trie that is built once."""
    known = rows.sparkSession.sparkContext.broadcast(trie(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(i, *m) for m in found_in(t or "", known.value)]
                if len(out) > HELD:
                    yield _batch(out, batch.schema.field(0).type)
                    out = []
            if out:
                yield _batch(out, batch.schema.field(0).type)

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, clause long, type string, start long, end long, value string")


def _batch(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = [id_kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "clause", "type", "start", "end", "value"])


def claims(mentions: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """id, clause, action (of those in the clause, the first in ``actions``), roles (other classes), targets (names, or
    the noun that stands in), contacts, times, amounts of each clause with an action."""
    of = lambda *kinds: F.col("type").isin(*kinds)
    rank = F.coalesce(*[F.when(F.col("type") == a, i) for i, a in enumerate(actions)])
    values = lambda *kinds: F.array_join(F.array_sort(F.collect_set(F.when(of(*kinds), F.col("value")))), ",")
    plain = (*actions, *VALUES, "name", "noun")
    c = mentions.groupBy("id", "clause").agg(
        F.min(rank).alias("rank"), F.array_join(F.array_sort(F.collect_set(F.when(~of(*plain), F.col("type")))), ",").alias("roles"), values("name", "noun").alias("targets"),
        F.count_if(of("mail", "address")).alias("contacts"), values("time").alias("times"), F.count_if(of("quantity", "number")).alias("amounts"),
    ).where("rank IS NOT NULL")
    names = F.array(*map(F.lit, actions))
    return c.select("id", "clause", F.get(names, F.col("rank")).alias("action"), "roles", "targets", "contacts", "times", "amounts")
