"""Pair joins, clustering, selection, packets and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.functions import text as T
from parley.operators import greedy, overlaps
from parley.operators.graph import components
from parley.operators.islands import gap_sessions
from parley.operators.nearest import nearest
from parley.operators.pairs import as_of, cluster_sizes, neighbours, placed, rank_near_blocks
from parley.plans import scans
from parley.plans.analytics import MINUTE, SCORED, _session_sql, scored_documents
from parley.plans.archive import DAY, M
from parley.plans.registry import query
from parley.streaming.state import cooldown_decisions
from parley.sources.tables import event_messages, table, turn_messages

HOUR = 60 * MINUTE
PLACED = f"{M}, p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m)"


@query(f"""WITH {PLACED}, x AS (SELECT a.row_id AS target, b.row_id AS neighbour, (CASE WHEN a.kind = b.kind THEN 30 ELSE 0 END) + (CASE WHEN a.k % 10 = b.k % 10 THEN 40 ELSE 0 END) + 12 - abs(a.pos - b.pos) AS relevance, abs(a.pos - b.pos) AS distance
 FROM p a JOIN p b ON a.chat_id = b.chat_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 12 AND abs(a.us - b.us) <= {20 * HOUR} AND b.kind <> 'error'
 AND NOT EXISTS (SELECT 1 FROM p c WHERE c.chat_id = a.chat_id AND c.pos > least(a.pos, b.pos) AND c.pos < greatest(a.pos, b.pos) AND c.kind = 'error')),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY relevance DESC, distance, neighbour) AS n FROM x)
SELECT target, neighbour, relevance, distance FROM r WHERE n <= 4""")
def context_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four neighbours within 12 places and 20 hours that no interruption parts from the target.
    Interruptions are counted by a running sum, so between two rows there are none if their counts say so."""
    p = placed(event_messages(spark, sf_dir))
    seen = F.sum((F.col("kind") == "error").cast("int")).over(W.partitionBy("chat_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    p = p.select("chat_id", "row_id", "us", "kind", "k", "pos", seen.alias("seen"))
    pairs = neighbours(p, 12).where(F.col("b_us") - F.col("a_us") <= 20 * HOUR).where(F.col("b_seen") - (F.col("b_kind") == "error").cast("int") == F.col("a_seen"))
    distance = (F.col("b_pos") - F.col("a_pos")).cast("long")
    score = F.when(F.col("a_kind") == F.col("b_kind"), 30).otherwise(0) + F.when(F.col("a_k") % 10 == F.col("b_k") % 10, 40).otherwise(0) + 12 - distance
    side = lambda x, y: F.struct(F.col(f"{x}_row_id").alias("target"), F.col(f"{y}_row_id").alias("neighbour"), F.col(f"{y}_kind").alias("kind"))
    both = pairs.select(score.alias("relevance"), distance.alias("distance"), F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).where("s.kind <> 'error'").select("relevance", "distance", "s.target", "s.neighbour")
    n = F.row_number().over(W.partitionBy("target").orderBy(F.desc("relevance"), "distance", "neighbour"))
    return both.withColumn("n", n).where("n <= 4").select("target", "neighbour", "relevance", "distance")


@query(f"""WITH {M}, q AS (SELECT row_id, chat_id, row_id - 150 * (1 + k % 3) AS reply_to FROM m) SELECT q.row_id, q.reply_to, t.kind AS target_kind, t.chat_id = q.chat_id AS same_chat FROM q JOIN m t ON t.row_id = q.reply_to""")
def explicit_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir)
    q = m.select("row_id", F.col("chat_id").alias("own"), (F.col("row_id") - 150 * (1 + F.col("k") % 3)).alias("reply_to"))
    t = m.select(F.col("row_id").alias("reply_to"), "chat_id", F.col("kind").alias("target_kind"))
    return q.join(t, "reply_to").select("row_id", "reply_to", "target_kind", (F.col("chat_id") == F.col("own")).alias("same_chat"))


@query(f"""WITH {M}, r AS (SELECT * FROM m WHERE kind = 'click'), o AS (SELECT * FROM m WHERE kind = 'view'),
j AS (SELECT r.chat_id, r.us, r.row_id, o.row_id AS right_row, o.us AS right_us FROM r ASOF LEFT JOIN (SELECT chat_id, us, max(row_id) AS row_id FROM o GROUP BY ALL) o ON r.chat_id = o.chat_id AND r.us >= o.us)
SELECT chat_id, us, row_id, CASE WHEN us - right_us <= {5 * HOUR} THEN right_row END AS right_row, CASE WHEN us - right_us <= {5 * HOUR} THEN right_us END AS right_us FROM j""")
def asof_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest view up to five hours before each click."""
    m = event_messages(spark, sf_dir)
    return as_of(m.where("kind = 'click'"), m.where("kind = 'view'"), "chat_id", "us", 5 * HOUR)


@query(f"""WITH {M}, k AS (SELECT chat_id, row_id, us, unnest([{{'r': 'day', 'k': (us // {DAY})::VARCHAR}}, {{'r': 'entity', 'k': (k % 10)::VARCHAR}}, {{'r': 'kind', 'k': kind}}]) AS p FROM m),
x AS (SELECT chat_id, row_id, p.r AS r, p.k AS k, row_number() OVER (PARTITION BY chat_id, p.r, p.k ORDER BY us, row_id) AS n FROM k)
SELECT a.row_id AS a, b.row_id AS b, string_agg(DISTINCT a.r, ',' ORDER BY a.r) AS reasons FROM x a JOIN x b ON a.chat_id = b.chat_id AND a.r = b.r AND a.k = b.k AND b.n > a.n AND b.n <= a.n + 3 GROUP BY ALL""")
def block_pairs_rank_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs from three blocking keys, at most three ranks apart under one of them."""
    keys = {"day": F.floor(F.col("us") / DAY), "entity": F.col("k") % 10, "kind": F.col("kind")}
    return rank_near_blocks(event_messages(spark, sf_dir), keys, 3, "chat_id", ["us", "row_id"], "row_id")


RELATION = "CASE WHEN a.kind = 'error' OR b.kind = 'error' THEN 'insufficient_context' WHEN a.k % 10 <> b.k % 10 AND a.kind = b.kind THEN 'conflict' WHEN a.k = b.k THEN 'same_event' WHEN a.k % 10 = b.k % 10 THEN 'same_topic' ELSE 'unrelated' END"


@query(f"""WITH {PLACED} SELECT a.row_id AS a, b.row_id AS b, {RELATION} AS label, a.k % 10 <> b.k % 10 AND a.kind = b.kind AS must_not_link FROM p a JOIN p b ON a.chat_id = b.chat_id AND b.pos > a.pos AND b.pos <= a.pos + 3""")
def pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five relations of rows up to three places apart: hard conflicts before links."""
    x = neighbours(placed(event_messages(spark, sf_dir)).select("chat_id", "row_id", "kind", "k", "pos"), 3)
    conflict = (F.col("a_k") % 10 != F.col("b_k") % 10) & (F.col("a_kind") == F.col("b_kind"))
    label = (
        F.when((F.col("a_kind") == "error") | (F.col("b_kind") == "error"), "insufficient_context").when(conflict, "conflict").when(F.col("a_k") == F.col("b_k"), "same_event")
        .when(F.col("a_k") % 10 == F.col("b_k") % 10, "same_topic").otherwise("unrelated")
    )
    return x.select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"), label.alias("label"), conflict.alias("must_not_link"))


@query("""WITH c AS (SELECT o_custkey AS cand, list_sort(list_distinct(list(o_orderpriority))) AS ev FROM orders GROUP BY o_custkey), b AS (SELECT s_suppkey AS code, list_sort(['1-URGENT', CASE WHEN s_suppkey % 2 = 0 THEN '2-HIGH' ELSE '5-LOW' END]) AS ev FROM supplier),
j AS (SELECT cand, code, c.ev = b.ev AS exact FROM c JOIN b ON list_has_any(c.ev, b.ev)),
g AS (SELECT cand, count(*) AS n, count(*) FILTER (exact) AS n_exact, min(code) FILTER (exact) AS exact_code, min(code) AS code FROM j GROUP BY cand)
SELECT c.cand, CASE WHEN n_exact >= 1 THEN exact_code WHEN n = 1 THEN g.code END AS code, CASE WHEN n_exact = 1 THEN 'exact' WHEN n_exact > 1 THEN 'exact_many' WHEN n = 1 THEN 'overlap' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM c LEFT JOIN g ON c.cand = g.cand""")
def evidence_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates to codebook rows by their evidence sets, never by text: exact set, else the only
    overlapping one, else ambiguous or none."""
    return _overlap(table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier"))


def _overlap(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Sets are compared once each, whatever the number of candidates and codes that have them."""
    c = orders.groupBy(F.col("o_custkey").alias("cand")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("ev"))
    b = suppliers.select(F.col("s_suppkey").alias("code"), F.array_sort(F.array(F.lit("1-URGENT"), F.when(F.col("s_suppkey") % 2 == 0, "2-HIGH").otherwise("5-LOW"))).alias("bev"))
    b = b.groupBy("bev").agg(F.count("*").alias("codes"), F.min("code").alias("code"))
    shared = c.select("ev").distinct().select("ev", F.explode("ev").alias("e")).join(b.select("bev", "codes", "code", F.explode("bev").alias("e")), "e").select("ev", "bev", "codes", "code").distinct()
    exact = F.col("ev") == F.col("bev")
    g = shared.groupBy("ev").agg(F.sum("codes").alias("n"), F.coalesce(F.sum(F.when(exact, F.col("codes"))), F.lit(0)).alias("ne"), F.min(F.when(exact, F.col("code"))).alias("ec"), F.min("code").alias("c1"))
    how = F.when(F.col("ne") == 1, "exact").when(F.col("ne") > 1, "exact_many").when(F.col("n") == 1, "overlap").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return c.join(g, "ev", "left").select("cand", F.when(F.col("ne") >= 1, F.col("ec")).when(F.col("n") == 1, F.col("c1")).alias("code"), how.alias("how"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS ev, l_linenumber AS line, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber IN (1, 2)),
e AS (SELECT DISTINCT 2 * x.l_partkey AS a, 2 * y.l_suppkey + 1 AS b FROM l x JOIN l y ON x.ev = y.ev AND x.line = 1 AND y.line = 2),
s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS i, x AS c FROM s UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.i),
k AS (SELECT i, min(c) AS root FROM r GROUP BY i)
SELECT root, count(*) FILTER (i % 2 = 0) AS n_a, count(*) FILTER (i % 2 = 1) AS n_b, CASE WHEN count(*) = 2 THEN 'matched' ELSE 'ambiguous' END AS status FROM k GROUP BY root""")
def bipartite_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides joined by shared evidence; components of one each are matched, larger ones ambiguous.
    Ids are 2 key for side a and 2 key + 1 for side b, so keys of any size stay apart."""
    return alignment(table(spark, sf_dir, "lineitem"))


def alignment(lines: DataFrame) -> DataFrame:
    a = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("ev"), (2 * F.col("l_partkey")).alias("a"))
    b = lines.where("l_linenumber = 2").select(F.col("l_orderkey").alias("ev"), (2 * F.col("l_suppkey") + 1).alias("b"))
    roots = components(a.join(b, "ev").select("a", "b").distinct())
    out = roots.groupBy("root").agg(F.count_if(F.col("id") % 2 == 0).alias("n_a"), F.count_if(F.col("id") % 2 == 1).alias("n_b"))
    return out.withColumn("status", F.when(F.col("n_a") + F.col("n_b") == 2, "matched").otherwise("ambiguous"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 5 <> 0),
j AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b, a.status AS s1, b.status AS s2, a.priority AS p1, b.priority AS p2 FROM a FULL JOIN b ON a.id = b.id)
SELECT id, f.field, CASE WHEN NOT in_a THEN 'missing_a' WHEN NOT in_b THEN 'missing_b' ELSE 'differs' END AS problem FROM (SELECT *, unnest([{'field': 'priority', 'x': p1, 'y': p2}, {'field': 'status', 'x': s1, 'y': s2}]) AS f FROM j) WHERE NOT in_a OR NOT in_b OR f.x IS DISTINCT FROM f.y""")
def annotation_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-level differences of two annotators; records that one side lacks are kept."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    a = o.where(k % 3 != 0).select(k.alias("id"), F.lit(True).alias("in_a"), F.col("o_orderstatus").alias("s1"), F.col("o_orderpriority").alias("p1"))
    b = o.where(k % 5 != 0).select(k.alias("id"), F.lit(True).alias("in_b"), F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s2"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("p2"))
    j = a.join(b, "id", "full").select("*", F.explode(F.array(F.struct(F.lit("priority").alias("field"), F.col("p1").alias("x"), F.col("p2").alias("y")), F.struct(F.lit("status").alias("field"), F.col("s1").alias("x"), F.col("s2").alias("y")))).alias("f"))
    problem = F.when(F.col("in_a").isNull(), "missing_a").when(F.col("in_b").isNull(), "missing_b").when(~F.col("f.x").eqNullSafe(F.col("f.y")), "differs")
    return j.select("id", "f.field", problem.alias("problem")).where("problem IS NOT NULL")


@query("""SELECT DISTINCT 'events.user_id' AS field, user_id AS value FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)
UNION ALL SELECT DISTINCT 'lineitem.l_orderkey', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 > 0)""")
def foreign_key_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a target, by anti-joins on distinct values."""
    e = table(spark, sf_dir, "events").select(F.lit("events.user_id").alias("field"), F.col("user_id").alias("value")).distinct()
    l = table(spark, sf_dir, "lineitem").select(F.lit("lineitem.l_orderkey").alias("field"), F.col("l_orderkey").alias("value")).distinct()  # noqa: E741
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("value"))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("value"))
    return e.join(c, "value", "left_anti").unionByName(l.join(o, "value", "left_anti")).select("field", "value")


@query("""WITH a AS (SELECT l_orderkey AS cand, count(*) AS n, count(*) FILTER (p_partkey IS NULL) AS bad FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 40) ON l_partkey = p_partkey GROUP BY l_orderkey) SELECT cand, n, CASE WHEN bad = 0 THEN 'selected' WHEN bad = n THEN 'no_allowed_evidence' ELSE 'outside_evidence' END AS decision FROM a""")
def evidence_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are selected if all their evidence is allowed; every other one has a reason."""
    allowed = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("ok"))
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(allowed, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("cand")).agg(F.count("*").alias("n"), F.count_if(F.col("ok").isNull()).alias("bad"))
    return a.select("cand", "n", F.when(F.col("bad") == 0, "selected").when(F.col("bad") == F.col("n"), "no_allowed_evidence").otherwise("outside_evidence").alias("decision"))


@query(f"""WITH {M}, c AS (SELECT k AS sender FROM m WHERE kind = 'purchase' GROUP BY k HAVING count(DISTINCT chat_id) >= 2)
SELECT row_id, CASE WHEN kind = 'purchase' THEN true WHEN kind = 'click' AND k IN (SELECT sender FROM c) THEN true WHEN kind = 'error' THEN NULL ELSE false END AS is_self FROM m""")
def self_attribution_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sender confirmed as oneself in two chats or more is oneself in synced rows too."""
    m = event_messages(spark, sf_dir)
    sure = m.where("kind = 'purchase'").groupBy("k").agg(F.countDistinct("chat_id").alias("chats")).where("chats >= 2").select("k", F.lit(True).alias("sure"))
    kind = F.col("kind")
    side = F.when(kind == "purchase", True).when((kind == "click") & F.col("sure"), True).when(kind == "error", None).otherwise(False)
    return m.join(sure, "k", "left").select("row_id", side.cast("boolean").alias("is_self"))


@query("""WITH t AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS term FROM documents), q AS (SELECT * FROM t WHERE doc_id % 20 = 0),
s AS (SELECT q.doc_id AS query, t.doc_id AS found, count(*) AS shared FROM q JOIN t ON q.term = t.term AND q.doc_id <> t.doc_id AND q.source = t.source GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, found) AS place FROM s)
SELECT query, found, shared, place FROM r WHERE place <= 5""")
def inverted_index_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of long terms by scope; a query's candidates are what its postings hold, best five."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("scope"), F.explode(T.terms(F.col("text"), 9)).alias("term"))
    return overlaps.best_overlaps(t, 20, 5)


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS found, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, found) AS place FROM s) SELECT query, found, place, round(sim, 4) AS similarity FROM r WHERE place <= 3""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest vectors of the same label: a stated set of queries against all rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return nearest(e, 20, 3).select("query", "found", "place", F.round("sim", 4).alias("similarity"))


@query(f"""WITH {M}, g AS (SELECT *, lag(us) OVER w AS prev_us, lag(k) OVER w AS prev_k FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY us, row_id)), b AS (SELECT *, CASE WHEN prev_us IS NULL OR us - prev_us > {7 * DAY} OR abs(k - prev_k) > 60 THEN 1 ELSE 0 END AS brk FROM g)
SELECT row_id, chat_id, sum(brk) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS flow FROM b""")
def adjacent_flow_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows only link neighbours, so their components are runs between breaks: a running sum."""
    order = W.partitionBy("chat_id").orderBy("us", "row_id")
    gap, turn = F.col("us") - F.lag("us").over(order), F.abs(F.col("k") - F.lag("k").over(order))
    brk = F.coalesce((gap > 7 * DAY) | (turn > 60), F.lit(True)).cast("int")
    rows = event_messages(spark, sf_dir).withColumn("brk", brk)
    return rows.select("row_id", "chat_id", F.sum("brk").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("flow"))


EDGES = f"{PLACED}, e AS (SELECT a.row_id AS a, b.row_id AS b FROM p a JOIN p b ON a.chat_id = b.chat_id AND b.pos > a.pos AND b.pos <= a.pos + 3 AND a.k % 10 = b.k % 10 AND a.kind <> 'error' AND b.kind <> 'error')"


def _thread_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = neighbours(placed(event_messages(spark, sf_dir)).select("chat_id", "row_id", "kind", "k", "pos"), 3)
    return x.where("a_k % 10 = b_k % 10 AND a_kind <> 'error' AND b_kind <> 'error'").select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"))


@query(f"WITH RECURSIVE {EDGES}, s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS i, x AS c FROM s UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.i) SELECT i AS id, min(c) AS root FROM r GROUP BY i")
def discourse_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of safe relations."""
    return components(_thread_edges(spark, sf_dir))


@query(scans.complete_link(EDGES, 3))
def complete_link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row joins the first event of its chat whose members it all relates to."""
    p = placed(event_messages(spark, sf_dir)).select(F.col("chat_id").alias("scope"), "pos", F.col("row_id").alias("id"))
    linked = _thread_edges(spark, sf_dir).groupBy(F.col("b").alias("id")).agg(F.collect_set("a").alias("linked"))
    return greedy.complete_link(p.join(linked, "id", "left"), 3)


@query(f"WITH RECURSIVE {EDGES}, s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS i, x AS c FROM s UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.i), k AS (SELECT i AS id, min(c) AS root FROM r GROUP BY i)\n" + """SELECT root AS event_id, count(*) AS claims, min(us) AS start_us, max(us) AS end_us, string_agg(DISTINCT kind, ',' ORDER BY kind) AS actions, min(k % 10) AS family FROM k JOIN m ON m.row_id = k.id GROUP BY root""".replace("k % 10", "m.k % 10"))
def event_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir).join(discourse_threads(spark, sf_dir), F.col("row_id") == F.col("id"))
    return m.groupBy(F.col("root").alias("event_id")).agg(F.count("*").alias("claims"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("actions"), F.min(F.col("k") % 10).alias("family"))


FAMILY = f"{M}, f AS (SELECT k % 10 AS family, kind AS action, chat_id, us FROM m)"


@query(f"WITH {FAMILY} SELECT family, count(*) AS events, count(DISTINCT chat_id) AS chats, min(us) AS first_us, CASE WHEN family = 0 THEN 0.4::DOUBLE ELSE 0.94::DOUBLE END AS confidence FROM f GROUP BY family")
def topic_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir).withColumn("family", F.col("k") % 10)
    return m.groupBy("family").agg(F.count("*").alias("events"), F.countDistinct("chat_id").alias("chats"), F.min("us").alias("first_us")).withColumn("confidence", F.when(F.col("family") == 0, 0.4).otherwise(0.94))


@query(f"WITH {FAMILY} SELECT family, action, count(*) AS events, 0.68::DOUBLE AS confidence FROM f GROUP BY ALL HAVING count(*) >= 2")
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir)
    return m.groupBy((F.col("k") % 10).alias("family"), F.col("kind").alias("action")).agg(F.count("*").alias("events")).where("events >= 2").withColumn("confidence", F.lit(0.68))


PRED = "d AS (SELECT doc_id, quality AS gold, CASE WHEN n_chars % 7 = 0 THEN 1 - quality ELSE quality END AS pred FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {PRED}, c AS (SELECT count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 1) AS fp, count(*) FILTER (gold = 1 AND pred = 0) AS fn FROM d) SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def relation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1; null where there is nothing to divide by."""
    d = _predicted(spark, sf_dir)
    c = d.agg(F.count_if((F.col("gold") == 1) & (F.col("pred") == 1)).alias("tp"), F.count_if((F.col("gold") == 0) & (F.col("pred") == 1)).alias("fp"), F.count_if((F.col("gold") == 1) & (F.col("pred") == 0)).alias("fn"))
    part = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", q.alias("gold"), F.when(F.col("n_chars") % 7 == 0, 1 - q).otherwise(q).alias("pred"))


CELLS = "x AS (SELECT label AS gold, vec_id % 13 AS pred FROM embeddings), c AS (SELECT pred, gold, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY pred) AS np, sum(n) OVER (PARTITION BY gold) AS ng FROM c)"


@query(f"WITH {CELLS} SELECT round(sum(n * n / np) / sum(n), 6) AS precision, round(sum(n * n / ng) / sum(n), 6) AS recall FROM s")
def bcubed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-Cubed from cell counts: every member's shares are those of its cell."""
    s = cluster_sizes(table(spark, sf_dir, "embeddings").select(F.col("label").alias("gold"), (F.col("vec_id") % 13).alias("pred")), "pred", "gold")
    n = F.col("n")
    return s.agg(F.round(F.sum(n * n / F.col("np")) / F.sum(n), 6).alias("precision"), F.round(F.sum(n * n / F.col("ng")) / F.sum(n), 6).alias("recall"))


@query(f"""WITH {CELLS}, t AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS tp FROM c), p AS (SELECT sum(np * (np - 1) // 2)::BIGINT AS pp FROM (SELECT DISTINCT pred, np FROM s)), g AS (SELECT sum(ng * (ng - 1) // 2)::BIGINT AS gp FROM (SELECT DISTINCT gold, ng FROM s))
SELECT tp, pp AS predicted_pairs, gp AS gold_pairs, round(2 * tp / (pp + gp), 6) AS f1 FROM t, p, g""")
def pairwise_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise cluster F1 from counts; no pair is made."""
    x = table(spark, sf_dir, "embeddings").select(F.col("label").alias("gold"), (F.col("vec_id") % 13).alias("pred"))
    sets = x.cube("pred", "gold").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    pairs = F.floor(F.col("n") * (F.col("n") - 1) / 2)
    sums = sets.agg(*[F.sum(F.when(F.col("g") == g, pairs)).cast("long").alias(a) for g, a in ((0, "tp"), (1, "predicted_pairs"), (2, "gold_pairs"))])
    return sums.withColumn("f1", F.round(2 * F.col("tp") / (F.col("predicted_pairs") + F.col("gold_pairs")), 6))


@query(f"WITH RECURSIVE {EDGES}, s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS i, x AS c FROM s UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.i), k AS (SELECT i AS id, min(c) AS root FROM r GROUP BY i), n AS (SELECT a.row_id AS a, b.row_id AS b FROM p a JOIN p b ON a.chat_id = b.chat_id AND b.pos = a.pos + 1 AND a.kind <> b.kind)\n" + "SELECT n.a, n.b, x.root AS event_id FROM n JOIN k x ON x.id = n.a JOIN k y ON y.id = n.b AND x.root = y.root")
def must_not_link_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that must not be linked but stand in one event."""
    p = placed(event_messages(spark, sf_dir)).select("chat_id", "row_id", "kind", "pos")
    n = neighbours(p, 1).where("a_kind <> b_kind").select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"))
    k = discourse_threads(spark, sf_dir)
    return n.join(k.select(F.col("id").alias("a"), "root"), "a").join(k.select(F.col("id").alias("b"), "root"), ["b", "root"]).select("a", "b", F.col("root").alias("event_id"))


@query("""WITH g AS (SELECT l_partkey AS acu, CASE WHEN l_partkey % 3 = 0 THEN 'must' WHEN l_partkey % 3 = 1 THEN 'may' ELSE 'exclude' END AS label FROM (SELECT DISTINCT l_partkey FROM lineitem)), c AS (SELECT l_orderkey AS claim, l_partkey AS acu FROM lineitem),
k AS (SELECT claim, count(*) FILTER (label <> 'exclude') AS good, count(*) AS refs FROM c JOIN g USING (acu) GROUP BY claim)
SELECT count(*) AS claims, round(count(*) FILTER (good > 0) / nullif(count(*), 0), 6) AS precision, (SELECT round(count(DISTINCT acu) FILTER (label = 'must') / (SELECT count(*) FROM g WHERE label = 'must'), 6) FROM c JOIN g USING (acu)) AS must_recall, count(*) FILTER (good = 0) AS unsupported FROM k""")
def acu_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against content units: precision over all claims, recall of those that must be there."""
    l = _claims(spark, sf_dir)  # noqa: E741
    return _acu(l, l)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("acu"))


def _acu(l: DataFrame, claims: DataFrame) -> DataFrame:  # noqa: E741
    label = F.when(F.col("acu") % 3 == 0, "must").when(F.col("acu") % 3 == 1, "may").otherwise("exclude")
    g = l.select("acu").distinct().withColumn("label", label)
    c = claims.join(g, "acu")
    k = c.groupBy("claim").agg(F.count_if(F.col("label") != "exclude").alias("good"))
    sums = k.agg(F.count("*").alias("claims"), F.round(F.count_if(F.col("good") > 0) / F.nullif(F.count("*"), F.lit(0)), 6).alias("precision"), F.count_if(F.col("good") == 0).alias("unsupported"))
    met = c.where("label = 'must'").agg(F.countDistinct("acu").alias("met"))
    must = g.where("label = 'must'").agg(F.count("*").alias("must"))
    one = sums.crossJoin(met).crossJoin(must)  # three single rows
    return one.select("claims", "precision", F.round(F.col("met") / F.nullif(F.col("must"), F.lit(0)), 6).alias("must_recall"), "unsupported")


@query("""WITH a AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'development' ELSE 'frozen' END AS split, n_chars FROM documents), p AS (SELECT n_chars AS unit, count(*) FILTER (split = 'development') AS dev, count(*) FILTER (split = 'frozen') AS frozen FROM a GROUP BY n_chars) SELECT unit, dev, frozen FROM p WHERE dev > 0 AND frozen > 0""")
def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation units that stand in both splits."""
    p = table(spark, sf_dir, "documents").groupBy(F.col("n_chars").alias("unit")).agg(F.count_if(F.col("doc_id") % 2 == 0).alias("dev"), F.count_if(F.col("doc_id") % 2 != 0).alias("frozen"))
    return p.where("dev > 0 AND frozen > 0")


@query("""SELECT * FROM (SELECT 'null_text' AS rule, count(*) FILTER (text IS NULL) AS violations FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (length(text) <> n_chars) FROM documents UNION ALL SELECT 'lang_enum', count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) FROM documents
UNION ALL SELECT 'label_enum', count(*) FILTER (quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) FROM labels UNION ALL SELECT 'value_sign', count(*) FILTER (value < 0) FROM events)""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rules with the number of rows that break each; one scan a table."""
    rules = {
        "documents": {"null_text": F.col("text").isNull(), "n_chars": F.length("text") != F.col("n_chars"), "lang_enum": ~F.col("lang").isin("en", "de", "fr", "es")},
        "labels": {"label_enum": ~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)},
        "events": {"value_sign": F.col("value") < 0},
    }
    parts = [table(spark, sf_dir, t).agg(*[F.count_if(c).alias(n) for n, c in own.items()]).unpivot([], list(own), "rule", "violations") for t, own in rules.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH RECURSIVE d AS (SELECT doc_id AS page, list_filter([lang, source, CASE WHEN contains(text, '@') THEN 'mail' ELSE 'plain' END], lambda x: x IS NOT NULL) AS labels FROM documents),
n AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM d) GROUP BY label),
r(step, chosen, covered) AS (SELECT 0, []::BIGINT[], []::VARCHAR[]
  UNION ALL SELECT step + 1, CASE WHEN best IS NULL THEN chosen ELSE list_append(chosen, best.page) END, CASE WHEN best IS NULL THEN list_append(covered, label) ELSE covered || best.labels END FROM (
    SELECT y.*, (SELECT arg_min({'page': page, 'labels': labels}, (-len(list_filter(d.labels, lambda x: NOT list_contains(y.covered, x))), page)) FROM d WHERE list_contains(d.labels, y.label) AND NOT list_contains(y.chosen, d.page)) AS best
    FROM (SELECT r.*, (SELECT arg_min(label, (n, label)) FROM n WHERE NOT list_contains(r.covered, n.label)) AS label FROM r WHERE len(r.chosen) < 10) y WHERE y.label IS NOT NULL)),
z AS (SELECT unnest(chosen) AS page, generate_subscripts(chosen, 1) - 1 AS place FROM r WHERE step = (SELECT max(step) FROM r))
SELECT page, place::INT AS place, array_to_string(labels, ',') AS labels FROM z JOIN d USING (page)""")
def stratum_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents that cover term labels, the rarest label first, whatever the number of labels."""
    mail = F.when(F.col("text").contains("@"), "mail").otherwise("plain")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.array_distinct(F.array_compact(F.array("lang", "source", mail))).alias("labels"))
    pages = greedy.greedy_cover(d, 10)
    return d.join(F.broadcast(spark.createDataFrame([(p, i) for i, p in enumerate(pages)] or [(-1, -1)], "page long, place int")), "page").select("page", "place", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY source, lang, n_chars // 500 ORDER BY score DESC, doc_id) AS own FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS round FROM k WHERE own = 1)
SELECT doc_id, source, round FROM r WHERE round <= 3""")
def package_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate a package (the best of an exact key), then three rounds over the scopes."""
    s = scored_documents(spark, sf_dir).select("doc_id", "source", "lang", F.floor(F.col("n_chars") / 500).alias("size"), "score")
    best = s.groupBy("source", "lang", "size").agg(F.max_by(F.struct("doc_id", "score"), F.struct("score", -F.col("doc_id"))).alias("b")).select("source", "b.doc_id", (-F.col("b.score")).alias("s"))
    return greedy.rounds(best, "source", ["s", "doc_id"]).where("round <= 3").select("doc_id", "source", "round")


@query(scans.cooldown(f"{PLACED}, f AS (SELECT chat_id, pos FROM p WHERE kind <> 'error'), t AS (SELECT chat_id, pos AS us, pos AS row_id, true AS wants, row_number() OVER (PARTITION BY chat_id ORDER BY pos) AS pos FROM f)", 5, "SELECT chat_id, row_id AS pos FROM s WHERE decision = 'reply'"))
def disjoint_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose windows of radius two do not touch, from the left of each chat."""
    p = placed(event_messages(spark, sf_dir)).where("kind <> 'error'").select("chat_id", F.col("pos").cast("long").alias("us"), F.col("pos").cast("long").alias("row_id"))
    chosen = cooldown_decisions(p, F.lit(True), 5, keep=["chat_id"])
    return chosen.where("decision = 'reply'").select("chat_id", F.col("row_id").alias("pos"))


@query(scans.batches(8, 300))
def chat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats into batches of at most 300 messages, a chat kept whole where it fits."""
    c = event_messages(spark, sf_dir).groupBy((F.col("chat_id") % 8).alias("scope"), "chat_id").agg(F.count("*").alias("n"))
    return greedy.fill_batches(c, 300)


@query("""SELECT sha256(source || '|' || coalesce(text, '')) AS content_id, count(*) AS refs, min(doc_id) AS first_ref, max(length(text)) AS chars FROM documents GROUP BY 1""")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies addressed by the hash of scope and text, with the references to each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.sha2(F.concat_ws("|", "source", F.coalesce("text", F.lit(""))), 256).alias("content_id"))
    return d.groupBy("content_id").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_ref"), F.max("n").cast("long").alias("chars"))


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) SELECT conv_id AS packet, (n - 1) // 2 AS page, count(*) AS items, count(*) FILTER (role = 'user') AS messages, count(*) FILTER (role = 'assistant') AS evidence FROM r GROUP BY ALL""")
def linear_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered streams of a packet onto pages of two of each: streams run side by side, never crossed."""
    n = F.row_number().over(W.partitionBy("chat_id", "role").orderBy("pos"))
    r = turn_messages(spark, sf_dir).withColumn("page", F.floor((n - 1) / 2))
    return r.groupBy(F.col("chat_id").alias("packet"), "page").agg(F.count("*").alias("items"), F.count_if(F.col("role") == "user").alias("messages"), F.count_if(F.col("role") == "assistant").alias("evidence"))


@query("""WITH x AS (SELECT conv_id AS packet, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT packet, 'm' || i AS handle, turn AS target FROM x""")
def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short handles for a packet's rows."""
    i = F.row_number().over(W.partitionBy("chat_id").orderBy("pos"))
    return turn_messages(spark, sf_dir).select(F.col("chat_id").alias("packet"), F.concat(F.lit("m"), i).alias("handle"), F.col("pos").alias("target"))


@query(f"""WITH {PLACED}, x AS (SELECT a.chat_id, a.row_id AS anchor, b.row_id AS member, abs(a.pos - b.pos) AS d FROM p a JOIN p b ON a.chat_id = b.chat_id AND abs(a.pos - b.pos) <= 2 WHERE a.kind = 'purchase' AND a.value >= 30)
SELECT anchor, count(*) AS members, count(*) FILTER (d > 0) AS context_only, min(member) AS first_member FROM x GROUP BY anchor""")
def context_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets: an anchor with its neighbours, which are context only."""
    p = placed(event_messages(spark, sf_dir)).select("chat_id", "row_id", "kind", "value", "pos")
    a = p.where("kind = 'purchase' AND value >= 30").select("chat_id", F.col("row_id").alias("anchor"), F.col("pos").alias("at"), F.explode(F.sequence(F.col("pos") - 2, F.col("pos") + 2)).alias("pos"))
    x = a.join(p, ["chat_id", "pos"])
    return x.groupBy("anchor").agg(F.count("*").alias("members"), F.count_if(F.col("pos") != F.col("at")).alias("context_only"), F.min("row_id").alias("first_member"))


@query(f"""WITH {M}, x AS (SELECT *, lag(kind) OVER (PARTITION BY chat_id ORDER BY us, row_id) AS before FROM m) SELECT row_id, chat_id, kind AS channel, before FROM x WHERE before IS NULL OR before <> kind""")
def gate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of a chat's channel; a repeated one adds nothing."""
    before = F.lag("kind").over(W.partitionBy("chat_id").orderBy("us", "row_id"))
    return event_messages(spark, sf_dir).withColumn("before", before).where("before IS NULL OR before <> kind").select("row_id", "chat_id", F.col("kind").alias("channel"), "before")


@query("""WITH c AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark), t AS (SELECT item_id, unnest(w) AS term, len(w) AS n FROM c), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS term FROM documents),
s AS (SELECT item_id, doc_id, n, count(*) AS i FROM t JOIN d USING (term) GROUP BY ALL) SELECT item_id, doc_id, i AS shared, n AS claim_terms, CASE WHEN 10 * i >= 8 * n THEN 'supported' ELSE 'partly' END AS verdict FROM s WHERE 2 * i >= n""")
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against an offline table of results by shared terms. Claim terms are few and go to every
    task up to a checked number; only shared terms are shuffled."""
    t = table(spark, sf_dir, "benchmark").select("item_id", T.terms(F.col("text"), 5).alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("term"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.terms(F.col("text"), 5)).alias("term"))
    t = F.broadcast(t) if t.count() <= 200_000 else t
    s = d.join(t, "term").groupBy("item_id", "doc_id", F.col("n").alias("claim_terms")).agg(F.count("*").alias("shared")).where("2 * shared >= claim_terms")
    return s.select("item_id", "doc_id", "shared", "claim_terms", F.when(10 * F.col("shared") >= 8 * F.col("claim_terms"), "supported").otherwise("partly").alias("verdict"))


@query(f"""WITH {M}, s AS (SELECT user_id AS chat_id, count(*) FILTER (event_type = 'view') AS views, count(*) AS n FROM events GROUP BY user_id) SELECT chat_id, views, n, CASE WHEN 100 * views >= 25 * n THEN 'dense' WHEN 100 * views >= 15 * n THEN 'medium' ELSE 'thin' END AS density FROM s""")
def signal_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_messages(spark, sf_dir).groupBy("chat_id").agg(F.count_if(F.col("kind") == "view").alias("views"), F.count("*").alias("n"))
    return s.withColumn("density", F.when(100 * F.col("views") >= 25 * F.col("n"), "dense").when(100 * F.col("views") >= 15 * F.col("n"), "medium").otherwise("thin"))


@query(_session_sql(720) + ", c AS (SELECT chat_id, session, count(*) AS n, count(*) FILTER (kind = 'error') AS errors FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY errors, n DESC, session) AS place FROM c) SELECT chat_id, session, n, errors, place FROM r WHERE place <= 3")
def interrupted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of 12 hours with the share of interruptions, best first within each chat's top three."""
    s = gap_sessions(event_messages(spark, sf_dir), 720).groupBy("chat_id", "session").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("errors"))
    return s.withColumn("place", F.row_number().over(W.partitionBy("chat_id").orderBy("errors", F.desc("n"), "session"))).where("place <= 3")
