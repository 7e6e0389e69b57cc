"""Repair of the turn structure of conversations by Knuth's lightest-derivation agenda.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``. The items of the
deduction are (i, q): the first i rows are dealt with and what was written leaves the automaton of
that pattern in state q. Rules keep, rerole or delete row i, or insert a row before it. An item's
value is (cost, audit), the audit being the initials of the edits in order; each rule adds to the
cost and appends to the audit, so it is superior (no result is below its antecedent) and monotone.
The agenda pops the least value first, which is final then, and stops at the goal.

Why appending is monotone: two audits of one item deal with the same rows, so where one is a prefix
of the other, the rest is insertions, and they cost. At equal cost neither is a prefix.

Rows stream through a task in order, in blocks of ``BLOCK`` rows. Between blocks there are at most
four values, one for each state; the last edit of each deals with a row, so the audits of two of
them are never prefixes of each other, and their rank stands for them in later comparisons. A hash
object goes with each. So memory doesn't grow with a conversation, but for its audit. The digest
of a conversation is one SHA-256 over its texts in order, which no two tasks can share: the rows
of one conversation pass through one task, as a stream. Repeated messages are found before that by
windows over (conversation, role, text), which do not keep a conversation together.

Defined cases: null role, text, conversation and turn stand as one space (a null conversation is a
conversation of its own and stays null in the result). Rows of equal turn are ordered by role, then
text. A role that starts with none of s, u, a can be reroled or deleted. A conversation without
rows has zeros, an empty audit and the hash of the empty string; an empty table has no rows. Other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the agenda works on at a time.
BLOCK = 128
SPACES = "\t\n\x0b\x0c\r "
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a whole pair; initial -> next state.
AFTER: list[dict[str, int]] = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The one role of user and assistant that can be written in a state, and the state after it.
WRITTEN = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
GOALS = (0, 3)

FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


@dataclass
class Row:
    role: str
    text: str
    delete: bool  # blank or seen before
    truncated: bool


@dataclass
class Entry:
    """A final item at the edge of a block."""

    state: int
    cost: int
    pieces: tuple | None  # (pieces before, audit of a block), shared between entries
    digest: object = field(default_factory=hashlib.sha256)
    written: bool = False


def edits(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """Initial, cost and next state of what can become of a row."""
    extra = TRUNCATED_COST if row.truncated else 0
    if not row.delete:
        if (after := AFTER[state].get(row.role[:1])) is not None:
            yield KEEP, extra, after
        yield REROLE, REROLE_COST + extra, WRITTEN[state][1]
    yield DELETE, DELETE_COST, state


def advance(entries: list[Entry], rows: list[Row], last: bool) -> list[Entry]:
    """Entries, ordered by their audits, taken past ``rows``; the goal alone if they are the last ones."""
    agenda: list[tuple] = [(x.cost, rank, "", 0, x.state, None, "") for rank, x in enumerate(entries)]
    heapq.heapify(agenda)
    final: dict[tuple[int, int], tuple] = {}
    ends: list[tuple] = []
    while agenda:
        item = heapq.heappop(agenda)
        cost, rank, audit, i, state, _, _ = item
        if (i, state) in final:
            continue
        final[i, state] = item
        if i == len(rows):
            if not last:
                ends.append(item)
                continue
            if state in GOALS:
                ends = [item]
                break
        else:
            for edit, price, after in edits(rows[i], state):
                if (i + 1, after) not in final:
                    heapq.heappush(agenda, (cost + price, rank, audit + edit, i + 1, after, (i, state), edit))
        after = WRITTEN[state][1]
        if (i, after) not in final:
            heapq.heappush(agenda, (cost + INSERT_COST, rank, audit + INSERT, i, after, (i, state), INSERT))
    out = []
    for cost, rank, audit, i, state, back, edit in sorted(ends, key=lambda x: x[1:3]):
        path = []
        while back is not None:
            path.append((edit, *back))
            _, _, _, _, _, back, edit = final[back]
        origin = entries[rank]
        entry = Entry(state, cost, (origin.pieces, audit), origin.digest.copy(), origin.written)
        for edit, i, before in reversed(path):
            if edit == DELETE:
                continue
            role = rows[i].role if edit == KEEP else WRITTEN[before][0]
            line = f"{role}:{'' if edit == INSERT else rows[i].text}"
            entry.digest.update((("\n" if entry.written else "") + line).encode())
            entry.written = True
        out.append(entry)
    return out


class Conversation:
    """Counts and repair of one conversation from its rows in order."""

    def __init__(self, conv_id: object):
        self.conv_id, self.entries, self.rows = conv_id, [Entry(0, 0, None)], []
        self.low = self.high = self.role = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and (self.turns == 0 or turn != self.turn):
            self.turns, self.turn = self.turns + 1, turn
            self.low, self.high = (turn if self.low is None else self.low), turn
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role
        said = text.rstrip(SPACES)
        blank, duplicate = not said, bool(said) and seen
        truncated = bool(said) and not seen and said[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if len(self.rows) == BLOCK:
            self.entries, self.rows = advance(self.entries, self.rows, last=False), []
        self.rows.append(Row(role, text, blank or duplicate, truncated))

    def result(self) -> tuple:
        goal = advance(self.entries, self.rows, last=True)[0]
        parts, pieces = [], goal.pieces
        while pieces is not None:
            pieces, part = pieces
            parts.append(part)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, goal.cost, "".join(reversed(parts)), goal.digest.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Conversation | None = None
    kind = None

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done))
        names = ["conv_id", *(x.split()[0] for x in FOUND.split(", "))]
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for conv_id, turn, role, text, seen, dropped in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen", "dropped"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = Conversation(conv_id)
            if not dropped:
                now.add(turn, role, text, seen)
        if done:
            yield batch_of(done)
    if now is not None:
        yield batch_of([now.result()])


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with nulls as spaces, whether their role and text were seen before, and a place for those that are dropped."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    earlier = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.asc_nulls_first("turn"))
    return rows.withColumn("seen", F.row_number().over(earlier) > 1)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and its digest of each conversation of ``rows`` (conv_id, turn, role, text).

    Rows whose column ``dropped``, if there is one, is true count as missing; their conversation stays."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    streamed = in_order(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")
    return streamed.mapInArrow(_repaired, f"conv_id {kind}, {FOUND}")


def repaired_messages(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each message: conv_id, seq from 1, edit, role, text, and the turn it had.

    Edits come from the audits of ``repair``; each that is no insertion belongs to the next row."""
    kept = in_order(rows).where("NOT dropped")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "seen")
    kept = kept.withColumn("row", F.row_number().over(order)).select(F.col("conv_id").alias("of"), "row", "turn", "role", "text")
    letters = F.transform(F.split("audit", ""), lambda x, i: F.struct(i.alias("at"), x.alias("edit")))
    n_written = F.length(F.regexp_replace("audit", DELETE, ""))
    steps = repaired.select("conv_id", (n_written % 2).alias("system"), F.explode(F.filter(letters, lambda s: s["edit"] != "")).alias("s"))
    by = Window.partitionBy("conv_id").orderBy("s.at").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(
        "conv_id", "system", F.col("s.edit").alias("edit"),
        F.when(F.col("s.edit") != INSERT, F.sum((F.col("s.edit") != INSERT).cast("int")).over(by)).alias("row_at"), F.sum((F.col("s.edit") != DELETE).cast("int")).over(by).alias("seq"),
    ).where(F.col("edit") != DELETE)
    found = steps.join(kept, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("row_at") == F.col("row")), "left")
    due = F.when((F.col("seq") - F.col("system")) % 2 == 1, "user").otherwise("assistant")
    return found.select("conv_id", "seq", "edit", F.when(F.col("edit") == KEEP, F.col("role")).otherwise(due).alias("role"), F.when(F.col("edit") == INSERT, "").otherwise(F.col("text")).alias("text"), "turn")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn``: dropped, emptied, without marks, repeated, of another role."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") <= 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))


#: The same as a fold over row numbers: the least (cost, audit) of each conversation, row and state.
ORACLE_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT range::UBIGINT, range::UBIGINT, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT) AS codes
  FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, codes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS h
  FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE h <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS row, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY row) > 1 AS seen FROM ordered
), faults AS (
  SELECT conv_id, turn, role, text, row, said = '' AS blank, said <> '' AND seen AS dup, said <> '' AND NOT seen AND NOT regexp_matches(said, '[.!?]$') AS cut,
    lag(role) OVER (PARTITION BY conv_id ORDER BY row) AS before
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(row) AS n
  FROM faults GROUP BY conv_id
), states(q, next, step) AS (VALUES (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
inserted(q, cost, audit, q2) AS (
  SELECT q, 0, '', q FROM states
  UNION ALL SELECT q, 2, 'I', next FROM states
  UNION ALL SELECT a.q, 4, 'II', b.next FROM states a JOIN states b ON b.q = a.next
), options AS (
  SELECT f.conv_id, f.row, s.q, o.cost, o.edit, o.q2
  FROM faults f, states s, LATERAL (VALUES
    (CASE WHEN NOT f.blank AND NOT f.dup AND (left(f.role, 1) = s.step OR (s.q = 0 AND left(f.role, 1) = 's')) THEN f.cut::INT END, 'K', CASE WHEN left(f.role, 1) = 's' THEN 1 ELSE s.next END),
    (CASE WHEN NOT f.blank AND NOT f.dup THEN 2 + f.cut::INT END, 'R', s.next),
    (3, 'D', s.q)) AS o(cost, edit, q2)
  WHERE o.cost IS NOT NULL
), steps AS (
  SELECT p.conv_id, p.row, i.q, min({'cost': i.cost + p.cost, 'audit': i.audit || p.edit}) AS v, p.q2
  FROM options p JOIN inserted i ON i.q2 = p.q GROUP BY ALL
), folded(conv_id, row, q, v) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': ''} FROM counts
  UNION ALL
  SELECT f.conv_id, f.row + 1, s.q2, min({'cost': f.v.cost + s.v.cost, 'audit': f.v.audit || s.v.audit})
  FROM folded f JOIN steps s ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.row = f.row + 1 AND s.q = f.q
  GROUP BY f.conv_id, f.row, s.q2
), best AS (
  SELECT f.conv_id, min({'cost': f.v.cost + i.cost, 'audit': f.v.audit || i.audit}) AS v
  FROM folded f JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.n = f.row JOIN inserted i ON i.q = f.q WHERE i.q2 IN (0, 3) GROUP BY f.conv_id
), letters AS (
  SELECT conv_id, unnest(string_split(v.audit, '')) AS edit, generate_subscripts(string_split(v.audit, ''), 1) AS place FROM best WHERE v.audit <> ''
), numbered AS (
  SELECT conv_id, edit, count(*) FILTER (edit <> 'I') OVER w AS row, count(*) FILTER (edit <> 'D') OVER w AS seq, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS written
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), messages AS (
  SELECT n.conv_id, string_agg(CASE WHEN edit = 'K' THEN f.role WHEN (seq - written % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY seq) AS body
  FROM numbered n LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.row = n.row WHERE edit <> 'D' GROUP BY n.conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.cost, 0)::BIGINT AS cost, coalesce(v.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN messages m ON m.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
