"""Work of queries that follows their input: what is shuffled, and what passes one task."""

import random
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import mentions as spans_of
from parley.operators import contract, events, graph, model, nearest, ordered, overlaps, phrases, segments
from parley.plans import events as event_plans
from parley.plans import profiled


def test_phrases_look_only_at_repeated_runs(spark):
    """Runs that one message uses never become rows, and those of others come out as before."""
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, 1, f"{long} a b c d e f"), (1, 2, f"x a b c d e f y {long[:3]}"), (1, 3, "a b c d"), (2, 4, "a b c d e"), (2, 5, "a b c d e a b c d e")]
    m = spark.createDataFrame(rows, "chat long, id long, text string").select("chat", "id", F.split("text", " ").alias("words"))
    held = phrases.repeated_rows(m, 4, 8, 2)
    assert held.where("gram LIKE '%w1%'").count() == 0 and held.count() < 30
    found = {tuple(r) for r in phrases.repeated_phrases(m, 4, 8, 2).collect()}
    assert found == {(1, "a b c d e f", 2), (1, "a b c d", 3), (2, "a b c d e", 2)}


def test_citation_pairs_are_not_shuffled(spark):
    """Pairs are counted in the partition of the lead, whatever the block of queries that is sent to it."""
    rows = spark.createDataFrame([(lead, ref % 7) for lead in range(40) for ref in range(lead, lead + 1 + lead % 4)] + [(1, 1), (2, None)], "lead long, ref long")
    sets = {}
    for r in rows.where("ref IS NOT NULL").collect():
        sets.setdefault(r["lead"], set()).add(r["ref"])
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a % 5 == 0 and a != b and len(sets[a] & sets[b]) >= max(1, (min(len(sets[a]), len(sets[b])) + 1) // 2))
    for block in (1_000, 3):
        found = overlaps.citation_overlaps(rows, 5, block)
        assert sorted(tuple(r) for r in found.collect()) == want
    plan = overlaps.citation_overlaps(rows, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 0


def test_mentions_leave_a_task_in_parts(spark, monkeypatch):
    """A task holds a bounded number of mentions, whatever a text or a batch has."""
    monkeypatch.setattr(spans_of, "HELD", 10)
    sizes = []
    monkeypatch.setattr(spans_of, "_spans", lambda rows, f=spans_of._spans: sizes.append(len(rows)) or f(rows))
    frames = []
    taken = SimpleNamespace(select=lambda *c: SimpleNamespace(mapInArrow=lambda run, schema: frames.append(run)))
    spans_of.mentions(taken, "doc_id", "text")
    batch = pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array(["123 " * 35, None])], names=["doc_id", "text"])
    out = [b.num_rows for b in frames[0](iter([batch]))]
    assert sizes == out == [10, 10, 10, 5]


def test_words_of_clauses_are_not_shuffled(spark, tmp_path):
    """Clauses travel, not their words: no window over words, and no sort of them."""
    spark.createDataFrame([(1, "They came with hammer and by train in London. In for. " + "in " * 3000), (1, "Go with hammer."), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    roles = profiled.profiled_roles(spark, str(tmp_path))
    got = sorted((r["clause"], r["role"], r["entity"], r["n"]) for r in roles.collect())
    assert got == [(0, "means", "hammer", 2), (0, "means", "train", 1), (0, "place", "london", 1)]
    assert "Window" not in roles._jdf.queryExecution().executedPlan().toString()
    parts = {r["clause"]: r for r in profiled.profiled_fragments(spark, str(tmp_path)).collect()}
    assert parts[0]["words"] == 12 and parts[0]["object"] == "hammer" and parts[2]["words"] == 3000


def test_small_parts_of_ordered_groups_take_no_rounds(spark, monkeypatch):
    """Parts that share no reference are decided side by side by one pass of the loop, larger ones in a few rounds."""
    rounds = []
    monkeypatch.setattr(ordered, "_free", lambda *a, f=ordered._free: rounds.append(1) or f(*a))
    rows = [(40 * k + i, [100 * k + (7 * i + j) % 11 for j in range(1 + i % 4)]) for k in range(30) for i in range(20)] + [(5_000, None), (5_001, [])]
    want = dict(ordered.decided_in_order([(p, ordered.Group(dict.fromkeys(r or [], p), (), (), ())) for p, r in rows], {}, ordered.overlap_rule(50)))
    df = spark.createDataFrame(rows, "pos long, refs array<long>")
    assert dict(ordered.ordered_groups(df, ordered.overlap_rule(50), 20).collect()) == want and not rounds
    assert dict(ordered.ordered_groups(df, ordered.overlap_rule(50), 8).collect()) == want and len(rounds) <= 2


class Batches:
    """Stands for a frame whose batches go through a step in this process."""

    def repartition(self, *a):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, step, schema):
        return step


def test_certain_rows_of_ordered_groups_go_by_arrays(monkeypatch):
    """Rows that bring the first group nothing new are no objects of the loop; decisions stay those of the loop."""
    calls, rng, rule = [], random.Random(5), ordered.overlap_rule(50)
    monkeypatch.setattr(ordered.Loop, "decided", lambda self, *a, f=ordered.Loop.decided: calls.append(1) or f(self, *a))
    rows = [(part, 10 * i + part, sorted(rng.sample(range(100 * part, 100 * part + 12), 1 + i % 4)) + [None] * (i % 50 == 0)) for part, n in enumerate([3_000, 5, 200, 2]) for i in range(n)]
    columns = {c: [r[k] for r in rows] for k, c in enumerate(["part", "id", "refs"])}
    n = len(rows)
    batch = pa.RecordBatch.from_pydict(columns | {"kind": [1] * n, "m": [len(r[2]) for r in rows]} | {c: [[]] * n for c in ("since", "topics", "any_domain", "all_domains")}, pa.schema([("part", pa.int64()), ("id", pa.int64()), ("refs", pa.list_(pa.int64())), ("kind", pa.int32()), ("m", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("since", "topics", "any_domain", "all_domains"))]))
    found = {}
    for out in ordered._looped(Batches(), rule)(iter(batch.slice(k, 700) for k in range(0, n, 700))):
        found |= dict(zip(*(c.to_pylist() for c in out.columns)))
    assert len(calls) < 1_300
    want = {}
    for part in range(4):
        want |= dict(ordered.decided_in_order([(pos, ordered.Group(dict.fromkeys(refs, pos), (), (), ())) for p, pos, refs in rows if p == part], {}, rule))
    assert found == want and len(set(want.values())) > 4


def test_parts_of_certain_joins_take_no_rounds(spark, monkeypatch):
    """A part of more than 20,000 rows whose rule says what is certain is decided by one pass of the loop."""
    monkeypatch.setattr(ordered, "_free", None)
    rows, rule = [(i, [i % 7, i % 11 + 7]) for i in range(25_000)], ordered.overlap_rule(50)
    want = dict(ordered.decided_in_order([(p, ordered.Group(dict.fromkeys(r, p), (), (), ())) for p, r in rows], {}, rule))
    df = spark.range(25_000).selectExpr("id AS pos", "array(id % 7, id % 11 + 7) AS refs")
    assert dict(ordered.ordered_groups(df, rule).collect()) == want


def test_first_rows_of_parts(spark):
    df = spark.createDataFrame([(p, 3 * i + p, [i]) for p, n in ((1, 500), (2, 40), (7, 39)) for i in range(n)], "part long, pos long, refs array<long>").repartition(5)
    got = sorted((r["part"], r["pos"]) for r in ordered._first(df, 40).collect())
    assert got == [(p, 3 * i + p) for p, n in ((1, 40), (2, 40), (7, 39)) for i in range(n)]


def test_packets_of_draws_are_decided_without_links(spark, monkeypatch):
    """Packets are parts by themselves: no search for linked findings, whatever their number."""
    monkeypatch.setattr(ordered, "components", None)
    rows = [(p, s, 0, f"t{s}", s, refs) for p in (1, 2) for s, refs in enumerate([["a", "b"], ["b", "c", "d", "e"], ["x"], ["d", "e"]])]
    found = model.merged_draws(spark.createDataFrame(rows, "packet long, seed long, no long, title string, importance long, refs array<string>"))
    assert sorted((r["packet"], r["first_seed"], r["support"], ",".join(r["refs"])) for r in found.collect()) == [(p, s, n, refs) for p in (1, 2) for s, n, refs in [(0, 3, "a,b,c,d,e"), (2, 1, "x")]]


def test_nearest_pairs_are_not_rows(spark):
    """Cosines come from products of cells: the values, ties and odd vectors are those of the join of all pairs."""
    rng = random.Random(4)
    pool = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(30)] + [[1.0] * 5, [2.0] * 5, [0.1] * 5, [0.0] * 5, [1.0, 2.0], [], [float("nan")] * 5, None]
    rows = [(i, pool[rng.randrange(len(pool))], rng.choice([0, 1, 1, 1, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    q = df.where("id % 4 = 0").select(F.col("id").alias("query"), F.col("v").alias("w"), "label")
    every = q.join(df, "label").where("query <> id").select("query", F.col("id").alias("found"), text.cosine(F.col("w"), F.col("v")).alias("sim"))
    want = {}
    for r in sorted(every.collect(), key=lambda r: (r["query"], -r["sim"], r["found"])):
        want.setdefault(r["query"], []).append((r["query"], r["found"], len(want.get(r["query"], ())) + 1, r["sim"]))
    want = sorted(x for found in want.values() for x in found[:3])
    for block in (1_000, 7):
        found = nearest.nearest(df, 4, 3, block)
        assert sorted(tuple(r) for r in found.collect()) == want
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_terms_are_counted_in_cells(spark):
    """Only the best of a cell are shuffled; repeated rows and ties count as in the plain join."""
    rng = random.Random(6)
    rows = [(i % 90, ["a", "a", "b", None, "b"][i % 5], f"t{rng.randrange(12)}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, scope string, term string")
    shared = Counter((a, b) for a, s, t in rows for b, z, u in rows if a % 4 == 0 and a != b and s is not None and (s, t) == (z, u))
    places = {}
    for (a, b), n in sorted(shared.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        places.setdefault(a, []).append((a, b, n, len(places.get(a, ())) + 1))
    want = sorted(x for found in places.values() for x in found[:3])
    for block, cell in ((1_000, 1_000), (20, 30)):
        found = overlaps.best_overlaps(df, 4, 3, block, cell)
        assert sorted(tuple(r) for r in found.collect()) == want
    assert overlaps.best_overlaps(df, 4, 3)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") <= 5


def test_terms_of_proposals_are_counted_before_items_travel(spark):
    """A lane is one where no two domains meet, and terms outside of the limits are never joined with items."""
    rows = [(1, "", "a"), (2, "mail", "a"), (3, "", "b"), (4, "mail", "b"), (5, "legal", "b"), (6, "", "b"), (7, "", "c")] + [(10 + i, "", "d") for i in range(9)] + [(30 + i, "mail,table", "e") for i in range(2)]
    found = events.lanes(spark.createDataFrame(rows, "id long, tag string, term string"), 8)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "", "one"), ("a", "mail", "one"), ("b", "", ""), ("e", "mail,table", "mail,table")]


def test_bundles_hold_partitions_of_bounded_rows(spark):
    """Partitions follow the rows, and messages are not shuffled again."""
    rows = spark.range(300).selectExpr("id % 3 AS chat_id", "id % 40 AS message_id", "CAST(id % 7 AS INT) AS fragment", "id % 2 = 0 AS cold")
    small, whole = segments.bundle_scales(rows, 10), segments.bundle_scales(rows, 1_000)
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect()))
    assert "hashpartitioning(chat_id#" in (plan := small._jdf.queryExecution().executedPlan().toString()) and ", 30), REPARTITION_BY_NUM" in plan


def test_links_that_lie_together_take_no_rounds(spark, monkeypatch):
    """Components and cycles inside a block are found by the task that holds it, others by rounds over what is left."""
    rng = random.Random(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    edges = [(100 * c + rng.randrange(30), 100 * c + rng.randrange(30)) for c in range(6) for _ in range(25)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    refs = [(100 * c + i, rng.choice([None, 100 * c + rng.randrange(40), 100 * c + max(0, i - 1)])) for c in range(6) for i in range(30)]
    to, ring = dict(refs), set()
    for start in to:
        at = to[start]
        for _ in to:
            ring |= {start} if at == start else set()
            at = to.get(at)
    pairs, rows = spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(refs, "id long, ref long")
    try:
        for held in (7, 1_000):
            assert {r["id"]: r["root"] for r in graph.components(pairs, held).collect()} == root
            assert sorted(r["id"] for r in contract.cycle_members(rows, held).collect()) == sorted(ring) and ring
        monkeypatch.setattr(graph, "_rounds", None)
        monkeypatch.setattr(contract, "_rounds", None)
        assert graph.components(pairs.coalesce(1)).count() == len(root)
        known = rows.where("ref IS NULL OR ref % 100 < 30").coalesce(1).unionByName(spark.createDataFrame([], "id long, ref long")).coalesce(1)
        gone = {x for x, r in refs if r is not None and r % 100 >= 30}
        ends = spark.createDataFrame([(x, None) for x in sorted(gone)], "id long, ref long")
        assert {r["id"] for r in contract.cycle_members(known.union(ends).coalesce(1)).collect()} == ring
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_classes_of_items_are_looked_for_once(spark, tmp_path):
    """Five classes, four domains and the rule of decisions: the score looks for no class again."""
    spark.createDataFrame([(1, "We approve the license of 10.0.0.1", "s0", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert event_plans.items(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 10
