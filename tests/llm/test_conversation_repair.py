import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from parley.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string"


def plain_repair(rows):
    """Every sequence of edits with at most two insertions at a place, tried out. rows: (role, text, delete, truncated)."""
    best = None
    choices = []
    for role, text, delete, cut in rows:
        options = [("D", 3, None)]
        if not delete:
            options += [("K", cut, (role, text)), ("R", 2 + cut, ("user", text)), ("R", 2 + cut, ("assistant", text))]
        choices.append(options)
    inserts = [()] + [(r,) for r in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    for picked in itertools.product(*choices):
        for before in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                cost, audit, out = cost + 2 * len(before[k]), audit + "I" * len(before[k]), out + [(r, "") for r in before[k]]
                if k < len(rows):
                    edit, price, kept = picked[k]
                    cost, audit, out = cost + price, audit + edit, out + ([kept] if kept else [])
            if re.fullmatch("(s?(ua)+)?", "".join((r or "-")[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 2, 128])
def test_agenda_equals_plain_search(block, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        c, seen, rows = cr.Conversation(1), set(), []
        for turn in range(rng.randint(0, 3)):
            role, text = rng.choice(["user", "assistant", "system", "tool", " ", ""]), rng.choice(["", " ", "a.", "b", "c?", "b"])
            blank, dup = not text.strip(), (role, text) in seen
            c.add(turn, role, text, dup)
            seen.add((role, text))
            rows.append((role, text, blank or dup, int(not blank and not dup and text[-1] not in ".!?")))
        assert c.result()[6:] == plain_repair(rows), rows


def folded(rows):
    """Least (cost, audit, written) by row and state."""
    states = {0: (0, "", ())}

    def better(to, q, value):
        if q not in to or value[:2] < to[q][:2]:
            to[q] = value

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for q, (cost, audit, written) in list(out.items()):
                better(out, cr.WRITTEN[q][1], (cost + 2, audit + "I", written + ((cr.WRITTEN[q][0], ""),)))
        return out

    for role, text, delete, cut in rows:
        after = {}
        for q, (cost, audit, written) in inserted(states).items():
            better(after, q, (cost + 3, audit + "D", written))
            if not delete:
                better(after, cr.WRITTEN[q][1], (cost + 2 + cut, audit + "R", written + ((cr.WRITTEN[q][0], text),)))
                if role[:1] in cr.AFTER[q]:
                    better(after, cr.AFTER[q][role[:1]], (cost + cut, audit + "K", written + ((role, text),)))
        states = after
    cost, audit, written = min(v for q, v in inserted(states).items() if q in (0, 3))
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written).encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 3, 7, 128])
def test_blocks_do_not_change_long_repairs(block, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK", block)
    rng = random.Random(99)
    for _ in range(25):
        c, rows = cr.Conversation(1), []
        for turn in range(rng.randint(1, 60)):
            role, text, seen = rng.choice(["user", "assistant", "assistant", "system", "x"]), rng.choice(["", "a.", "b"]), rng.random() < 0.2
            c.add(turn, role, text, seen)
            rows.append((role, text, not text or seen, int(text == "b" and not seen)))
        assert c.result()[6:] == folded(rows)


def conversations(spark, seed=3, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes. No!", "open", "Why?  ", " \n", "", "a.b", "Well, é."]) + str(rng.randrange(4)) * rng.randrange(2)
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice([role] * 12 + ["system", None, "tool"]), None if rng.random() < 0.05 else text, "x", "y"))
    rows += [(None, None, None, None, None, None), (None, 1, "user", "a.", "", ""), (5000, None, "user", "Hm.", "", ""), (5000, None, "user", "Hm.", "", ""), (5000, None, "assistant", "Ah.", "", "")]
    rows += [(6000, t, ("user", "assistant")[t % 2], f"long {t}. " * 30, "", "") for t in range(500)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_query_equals_sql(spark):
    table, rows = conversations(spark)
    got = sorted(map(tuple, cr.repaired_conversations(table).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    assert got == sorted(con.execute(cr.ORACLE_SQL).fetchall(), key=str)
    assert {r[0] for r in got} == {r[0] for r in rows} and any(r[6] for r in got)
    kinds = [zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 for r in rows]
    assert all(k in kinds for k in range(5))


def test_repaired_messages_are_what_was_hashed(spark):
    table, _ = conversations(spark, 4, 60)
    rows = cr.damaged(table)
    found = cr.repair(rows)
    messages = {}
    for r in cr.repaired_messages(rows, found).orderBy("conv_id", "seq").collect():
        messages.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in found.collect():
        said = messages.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(said).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))


def test_empty_table(spark):
    assert cr.repaired_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
