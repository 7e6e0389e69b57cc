"""Segmentation by ordered rules, pages under a token budget, task recovery, claims, capped lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.functions import text as T
from parley.operators.pairs import placed
from parley.operators.segments import scan
from parley.plans.analytics import MINUTE
from parley.plans.archive import M
from parley.plans.dialogue import DONE, ONGOING, PURPOSE
from parley.plans.registry import ORACLES, query
from parley.plans.relations import cosine_topk, inverted_index_retrieval
from parley.sources.tables import event_messages, table, turn_messages
from parley.streaming.ingest import decision_stream

HOUR = 60 * MINUTE
GAP = 15 * HOUR


@query(f"""WITH {M}, r AS (SELECT m.*, t.row_id IS NOT NULL AS reply FROM m LEFT JOIN m t ON t.row_id = m.row_id - 150 * (1 + m.k % 3) AND t.chat_id = m.chat_id AND m.kind = 'click'),
g AS (SELECT *, us - lag(us) OVER w AS gap, lag(kind) OVER w AS kb, lag(k) OVER w AS before FROM r WINDOW w AS (PARTITION BY chat_id ORDER BY us, row_id)),
b AS (SELECT *, CASE WHEN gap IS NULL THEN 'scope' WHEN gap > {GAP} AND NOT reply THEN 'gap' WHEN kind = kb AND gap <= {2 * HOUR} THEN NULL
  WHEN kind = 'purchase' AND k // 10 <> before // 10 AND k % 10 <> before % 10 THEN 'explicit_shift' WHEN k // 10 <> before // 10 AND gap > {min(GAP // 3, 4 * HOUR)} AND NOT reply THEN 'topic_shift'
  WHEN k = before AND kind <> kb AND gap > {3 * HOUR} THEN 'speaker_shift' END AS boundary FROM g),
s AS (SELECT *, count(boundary) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS segment FROM b),
f AS (SELECT *, first_value(row_id) OVER (PARTITION BY chat_id, segment ORDER BY us, row_id) AS first FROM s)
SELECT row_id, segment, boundary, CASE WHEN row_id = first THEN 'opener' WHEN kind = 'error' THEN 'context' ELSE 'substantive' END AS role,
  substr(sha256('segment|=' || chat_id || '|=' || first), 1, 20) AS segment_id FROM f""")
def dialogue_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by ordered rules: scope, gap unless replied to, social continuation, explicit shift, topic
    shift after a pause, speaker shift; with roles and stable ids. A reply's target may stand in any
    earlier segment of the chat."""
    m = event_messages(spark, sf_dir)
    target = m.select(F.col("row_id").alias("target"), F.col("chat_id").alias("target_chat"))
    asked = (F.col("target") == F.col("row_id") - 150 * (1 + F.col("k") % 3)) & (F.col("target_chat") == F.col("chat_id")) & (F.col("kind") == "click")
    r = m.join(target, asked, "left").withColumn("reply", F.col("target").isNotNull())
    w = W.partitionBy("chat_id").orderBy("us", "row_id")
    g = r.select("chat_id", "us", "row_id", "kind", "k", "reply", (F.col("us") - F.lag("us").over(w)).alias("gap"), F.lag("kind").over(w).alias("kb"), F.lag("k").over(w).alias("before"))
    gap, reply, k, before = F.col("gap"), F.col("reply"), F.col("k"), F.col("before")
    other = F.floor(k / 10) != F.floor(before / 10)
    boundary = (
        F.when(gap.isNull(), "scope").when((gap > GAP) & ~reply, "gap").when((F.col("kind") == F.col("kb")) & (gap <= 2 * HOUR), None)
        .when((F.col("kind") == "purchase") & other & (k % 10 != before % 10), "explicit_shift").when(other & (gap > min(GAP // 3, 4 * HOUR)) & ~reply, "topic_shift")
        .when((k == before) & (F.col("kind") != F.col("kb")) & (gap > 3 * HOUR), "speaker_shift")
    )
    s = g.withColumn("boundary", boundary).withColumn("segment", F.count("boundary").over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = s.withColumn("first", F.first("row_id").over(W.partitionBy("chat_id", "segment").orderBy("us", "row_id")))
    role = F.when(F.col("row_id") == F.col("first"), "opener").when(F.col("kind") == "error", "context").otherwise("substantive")
    return s.select("row_id", "segment", "boundary", role.alias("role"), T.stable_id("segment", F.col("chat_id"), F.col("first")).alias("segment_id"))


BUDGET, PAGE_ROWS = 300, 3


@query(f"""WITH RECURSIVE t AS (SELECT conv_id AS chat_id, turn AS turn_no, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
s AS (SELECT chat_id, turn_no, pos, tokens, 0::BIGINT AS page, tokens AS used, 1 AS n FROM t WHERE pos = 1
 UNION ALL SELECT t.chat_id, t.turn_no, t.pos, t.tokens, s.page + (s.used + t.tokens > {BUDGET} OR s.n >= {PAGE_ROWS})::BIGINT,
  CASE WHEN s.used + t.tokens > {BUDGET} OR s.n >= {PAGE_ROWS} THEN t.tokens ELSE s.used + t.tokens END, CASE WHEN s.used + t.tokens > {BUDGET} OR s.n >= {PAGE_ROWS} THEN 1 ELSE s.n + 1 END
 FROM s JOIN t ON t.chat_id = s.chat_id AND t.pos = s.pos + 1)
SELECT chat_id, turn_no, page, tokens, CASE WHEN tokens > {BUDGET} THEN 'pending' ELSE 'ready' END AS status FROM s""")
def token_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns filled into pages in order, under a count cap and a token budget; a turn over the budget is
    a page of its own that waits."""
    rows = turn_messages(spark, sf_dir).select("chat_id", F.col("pos").alias("turn_no"), T.token_estimate(F.col("content")).alias("tokens"))

    def step(state: dict, row) -> dict:
        tokens = int(row.tokens)
        if state["n"] and (state["used"] + tokens > BUDGET or state["n"] >= PAGE_ROWS):
            state["page"], state["used"], state["n"] = state["page"] + 1, 0, 0
        state["used"], state["n"] = state["used"] + tokens, state["n"] + 1
        return {"chat_id": row.chat_id, "turn_no": row.turn_no, "page": state["page"], "tokens": tokens, "status": "pending" if tokens > BUDGET else "ready"}

    return scan(rows, "chat_id", ["turn_no"], step, "chat_id long, turn_no long, page long, tokens long, status string", lambda: {"page": 0, "used": 0, "n": 0})


ATTEMPTS = 3


@query(f"""WITH RECURSIVE t AS (SELECT l_orderkey AS task_id, ['claim', 'claim', 'claim', 'ok', 'error', 'crash', 'retry'][l_partkey % 7 + 1] AS kind,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
s AS (SELECT task_id, 0::BIGINT AS pos, 'pending' AS status, 0::BIGINT AS attempts FROM (SELECT DISTINCT task_id FROM t)
 UNION ALL SELECT t.task_id, t.pos, CASE WHEN kind = 'claim' AND status = 'pending' THEN 'sending' WHEN kind = 'ok' AND status = 'sending' THEN 'succeeded'
   WHEN kind = 'error' AND status = 'sending' THEN CASE WHEN attempts >= {ATTEMPTS} THEN 'failed' ELSE 'pending' END
   WHEN kind = 'crash' AND status = 'sending' THEN 'pending' WHEN kind = 'retry' AND status = 'failed' THEN 'pending' ELSE status END,
  CASE WHEN kind = 'claim' AND status = 'pending' THEN attempts + 1 WHEN kind = 'retry' AND status = 'failed' THEN 0 ELSE attempts END FROM s JOIN t ON t.task_id = s.task_id AND t.pos = s.pos + 1)
SELECT task_id, arg_max(status, pos) AS status, arg_max(attempts, pos) AS attempts FROM s GROUP BY task_id""")
def task_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks replayed from their log: claims, results, crashes that put a claimed task back, and retries,
    which only a failed task takes."""
    kind = F.element_at(F.array(*map(F.lit, ("claim", "claim", "claim", "ok", "error", "crash", "retry"))), (F.col("l_partkey") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), kind.alias("kind"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

    def step(state: dict, row) -> dict:
        status, attempts = state["status"], state["attempts"]
        if row.kind == "claim" and status == "pending":
            status, attempts = "sending", attempts + 1
        elif row.kind == "ok" and status == "sending":
            status = "succeeded"
        elif row.kind == "error" and status == "sending":
            status = "failed" if attempts >= ATTEMPTS else "pending"
        elif row.kind == "crash" and status == "sending":
            status = "pending"
        elif row.kind == "retry" and status == "failed":
            status, attempts = "pending", 0
        state["status"], state["attempts"], state["n"] = status, attempts, state["n"] + 1
        return {"task_id": row.task_id, "n": state["n"], "status": status, "attempts": attempts}

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    seen = scan(rows, "task_id", order, step, "task_id long, n long, status string, attempts long", lambda: {"status": "pending", "attempts": 0, "n": 0})
    last = seen.groupBy("task_id").agg(F.max_by(F.struct("status", "attempts"), "n").alias("x"))
    return last.select("task_id", "x.status", "x.attempts")


@query("""WITH t AS (SELECT conv_id, turn, text, regexp_extract(lower(lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn)), '\\p{L}{4,}') AS quoted FROM conversations)
SELECT conv_id AS chat_id, turn AS pos, quoted, contains(lower(text), quoted) AS found FROM t WHERE quoted <> ''""")
def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn holds what it would quote: the first longer word of the turn two before it."""
    before = F.lag("content", 2).over(W.partitionBy("chat_id").orderBy("pos"))
    rows = turn_messages(spark, sf_dir).withColumn("quoted", F.regexp_extract(F.lower(before), "\\p{L}{4,}", 0)).where("quoted <> ''")
    return rows.select("chat_id", "pos", "quoted", F.contains(F.lower("content"), F.col("quoted")).alias("found"))


@query("""WITH d AS (SELECT doc_id, source, n_chars, sha256(coalesce(text, '')) AS h, CASE WHEN doc_id % 5 = 0 THEN 'frozen' ELSE 'development' END AS split FROM documents),
h AS (SELECT h, count(DISTINCT split) AS splits FROM d GROUP BY h), s AS (SELECT source, count(DISTINCT split) AS splits, count(*) AS n FROM d GROUP BY source)
SELECT 'text_in_both' AS finding, count(*) FILTER (splits = 2) AS n FROM h UNION ALL SELECT 'source_in_one', count(*) FILTER (splits = 1) FROM s
UNION ALL SELECT 'frozen_share_percent', (100 * count(*) FILTER (split = 'frozen')) // count(*) FROM d UNION ALL SELECT 'empty_frozen', count(*) FILTER (split = 'frozen' AND n_chars = 0) FROM d""")
def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a split: texts on both sides, sources on one only, its share, empty rows."""
    d = table(spark, sf_dir, "documents").select("source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), (F.col("doc_id") % 5 == 0).alias("frozen"))
    both = lambda key: d.groupBy(key).agg(F.bool_or("frozen").alias("f"), F.bool_or(~F.col("frozen")).alias("d"))
    texts = both("h").agg(F.count_if(F.col("f") & F.col("d")).alias("n"))
    sources = both("source").agg(F.count_if(F.col("f") != F.col("d")).alias("n"))
    sums = d.agg(F.expr("100 * count_if(frozen) DIV count(*)").alias("frozen_share_percent"), F.count_if(F.col("frozen") & (F.col("n_chars") == 0)).alias("empty_frozen"))
    named = lambda name, rows: rows.select(F.lit(name).alias("finding"), "n")
    return named("text_in_both", texts).unionByName(named("source_in_one", sources)).unionByName(sums.unpivot([], ["frozen_share_percent", "empty_frozen"], "finding", "n"))


CLAIMS = 5


@query(f"""WITH c AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?\\n]+[.!?]?'), lambda s: regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '[?]$') AND NOT regexp_matches(s, '(?i)(?:^|[^a-z])(?:this|este|diese)(?:[^a-z]|$)')) AS c FROM documents)
SELECT doc_id, least(len(c), {CLAIMS}) AS claims, len(c) AS found, sha256(array_to_string(c[:{CLAIMS}], '|')) AS claims_sha FROM c WHERE len(c) > 0""")
def checkable_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a number that are neither questions nor opinions, the first five of a text."""
    opinion = "(?i)(?:^|[^a-z])(?:this|este|diese)(?:[^a-z]|$)"
    kept = F.filter(F.regexp_extract_all("text", F.lit("[^.!?\\n]+[.!?]?"), F.lit(0)), lambda s: F.rlike(s, F.lit("[0-9]")) & ~F.rlike(s, F.lit("[?]$")) & ~F.rlike(s, F.lit(opinion)))
    rows = table(spark, sf_dir, "documents").select("doc_id", kept.alias("c")).where(F.size("c") > 0)
    n = F.size("c").cast("long")
    return rows.select("doc_id", F.least(n, F.lit(CLAIMS)).cast("long").alias("claims"), n.alias("found"), F.sha2(F.array_join(F.slice("c", 1, CLAIMS), "|"), 256).alias("claims_sha"))


@query(f"""WITH {M}, g AS (SELECT *, last_value(CASE WHEN kind IN ('error', 'signup') THEN kind END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_gate,
  first_value(CASE WHEN kind = 'signup' THEN row_id END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS opener FROM m)
SELECT chat_id, count(*) FILTER (kind = 'error' AND last_gate IS DISTINCT FROM 'error') AS closed, count(*) FILTER (kind = 'signup' AND last_gate = 'error') AS reopened,
  count(*) FILTER (kind NOT IN ('error', 'signup') AND last_gate = 'error') AS held, count(*) FILTER (kind NOT IN ('error', 'signup') AND last_gate = 'error' AND opener IS NOT NULL) AS released FROM g GROUP BY chat_id""")
def gate_reactivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of a chat: how often they closed and opened again, what they held, and what was released."""
    order = W.partitionBy("chat_id").orderBy("us", "row_id")
    kind = F.col("kind")
    last = F.last(F.when(kind.isin("error", "signup"), kind), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    opener = F.max(F.when(kind == "signup", F.lit(True))).over(order.rowsBetween(1, W.unboundedFollowing))
    g = event_messages(spark, sf_dir).withColumn("last", last).withColumn("opener", opener)
    shut, plain = F.coalesce(F.col("last") == "error", F.lit(False)), ~kind.isin("error", "signup")
    return g.groupBy("chat_id").agg(
        F.count_if((kind == "error") & ~shut).alias("closed"), F.count_if((kind == "signup") & shut).alias("reopened"),
        F.count_if(plain & shut).alias("held"), F.count_if(plain & shut & F.col("opener").isNotNull()).alias("released"),
    )


CAPS = {"view": 24, "click": 12, "purchase": 8, "signup": 6, "error": 3}


@query(f"""WITH {M}, r AS (SELECT kind, row_id, value, row_number() OVER (PARTITION BY kind ORDER BY value DESC, row_id) AS place FROM m)
SELECT kind AS list, row_id, place FROM r WHERE place <= CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, n in CAPS.items())} ELSE 0 END""")
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five lists of a summary, each under its own cap. What can't be in any list leaves before the
    shuffle."""
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("value"), "row_id"))
    cap = F.lit(0)
    for kind, n in CAPS.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    top = event_messages(spark, sf_dir).select("kind", "row_id", "value").withColumn("place", place).where(F.col("place") <= max(CAPS.values()))
    return top.where(F.col("place") <= cap).select(F.col("kind").alias("list"), "row_id", F.col("place").cast("long").alias("place"))


ACTIONS = {"plan": PURPOSE, "happened": DONE, "holds": ONGOING}


@query(f"""WITH s AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^.!?\\n]+')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\\n]+'), 1) AS i FROM conversations),
c AS (SELECT conv_id, turn, i, CASE {" ".join(f"WHEN regexp_matches(s, '{p}') THEN '{a}'" for a, p in ACTIONS.items())} ELSE 'mention' END AS action,
  coalesce(nullif(regexp_extract(s, '\\p{{L}}{{9,}}'), ''), nullif(regexp_extract(s, '\\p{{L}}{{5,}}'), '')) AS noun FROM s)
SELECT conv_id AS chat_id, turn AS pos, i - 1 AS sentence, action, noun, substr(sha256('claim|=' || conv_id || '|=' || turn || '|=' || (i - 1)), 1, 20) AS claim_id FROM c WHERE noun IS NOT NULL""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of turns: the first action that fits in order of priority, and a long noun, else a shorter."""
    rows = turn_messages(spark, sf_dir).select("chat_id", "pos", F.posexplode(F.regexp_extract_all("content", F.lit("[^.!?\\n]+"), F.lit(0))).alias("sentence", "s"))
    action = F.when(F.col("s").rlike(PURPOSE), "plan").when(F.col("s").rlike(DONE), "happened").when(F.col("s").rlike(ONGOING), "holds").otherwise("mention")
    first = lambda pattern: F.nullif(F.regexp_extract("s", pattern, 0), F.lit(""))
    c = rows.withColumn("noun", F.coalesce(first("\\p{L}{9,}"), first("\\p{L}{5,}"))).where("noun IS NOT NULL")
    return c.select("chat_id", "pos", F.col("sentence").cast("long").alias("sentence"), action.alias("action"), "noun", T.stable_id("claim", F.col("chat_id"), F.col("pos"), F.col("sentence")).alias("claim_id"))


@query(f"""WITH {M}, p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m),
b AS (SELECT *, max(CASE WHEN kind = 'purchase' THEN pos END) OVER w AS last_topic, max(CASE WHEN kind = 'signup' THEN pos END) OVER w AS last_greeting FROM p
  WINDOW w AS (PARTITION BY chat_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT b.row_id, x.row_id AS before, b.pos - x.pos - 1 AS between_rows, CASE WHEN b.last_greeting > x.pos THEN 'greeting' ELSE 'drift' END AS reason
FROM b JOIN p x ON x.chat_id = b.chat_id AND x.pos = b.last_topic WHERE b.kind = 'purchase' AND b.k // 10 <> x.k // 10""")
def topic_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between two topic-bearing rows that follow each other, and what lies between."""
    p = placed(event_messages(spark, sf_dir))
    w = W.partitionBy("chat_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "purchase", F.struct("pos", "row_id", "k")), ignorenulls=True).over(w)
    greeting = F.max(F.when(F.col("kind") == "signup", F.col("pos"))).over(w)
    b = p.withColumn("x", last).withColumn("greeting", greeting).where("kind = 'purchase'").where(F.floor(F.col("k") / 10) != F.floor(F.col("x.k") / 10))
    reason = F.when(F.col("greeting") > F.col("x.pos"), "greeting").otherwise("drift")
    return b.select("row_id", F.col("x.row_id").alias("before"), (F.col("pos") - F.col("x.pos") - 1).cast("long").alias("between_rows"), reason.alias("reason"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'broken' WHEN conv_id % 9 = 0 AND turn = 1 THEN 'shape' ELSE 'ok' END AS form FROM conversations),
r AS (SELECT conv_id * 4 + least(turn, 3) AS id, conv_id, turn, form, row_number() OVER (PARTITION BY form, conv_id * 4 + least(turn, 3) ORDER BY turn) AS n FROM l)
SELECT conv_id, turn, CASE WHEN form = 'ok' AND n > 1 THEN 'repeated' ELSE form END AS outcome FROM r""")
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON lines, checked for syntax, shape and repeated ids; the first of an id stays."""
    t = turn_messages(spark, sf_dir)
    known = F.struct((F.col("chat_id") * 4 + F.least("pos", F.lit(3))).alias("id"), F.col("role").alias("role"), F.col("content").alias("text"))
    lacking = F.struct(known["id"].alias("id"), F.col("content").alias("text"))
    line = F.when(F.col("pos") % 5 == 4, F.lit("{not a record")).when((F.col("chat_id") % 9 == 0) & (F.col("pos") == 1), F.to_json(lacking)).otherwise(F.to_json(known))
    rows = t.select("chat_id", "pos", F.from_json(line, "id long, role string, text string, _corrupt_record string").alias("r"))
    form = F.when(F.col("r._corrupt_record").isNotNull(), "broken").when(F.col("r.role").isNull(), "shape").otherwise("ok")
    rows = rows.select("chat_id", "pos", F.col("r.id").alias("id"), form.alias("form"))
    n = F.row_number().over(W.partitionBy("form", "id").orderBy("pos"))
    # What has no id has no repetition either.
    checked = rows.where("form = 'ok'").withColumn("n", n).select("chat_id", "pos", F.when(F.col("n") > 1, "repeated").otherwise("ok").alias("outcome"))
    return checked.unionByName(rows.where("form <> 'ok'").select("chat_id", "pos", F.col("form").alias("outcome"))).select(F.col("chat_id").alias("conv_id"), F.col("pos").alias("turn"), "outcome")


@query("""WITH l AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_totalprice AS p FROM orders WHERE o_orderkey % 3 <> 0),
r AS (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderkey WHEN o_orderkey % 11 <> 0 THEN o_orderkey::VARCHAR END AS rid, o_custkey AS c, o_orderdate AS d, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 0),
a AS (SELECT 'x' || o_orderkey AS alias, o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 14 = 0),
n AS (SELECT r.*, coalesce(a.id, CASE WHEN rid NOT LIKE 'x%' THEN rid END) AS key, a.id IS NOT NULL AS aliased FROM r LEFT JOIN a ON a.alias = r.rid),
m AS (SELECT l.k, n.src, CASE WHEN aliased THEN 'alias' ELSE 'id' END AS how FROM l JOIN n ON n.key = l.k::VARCHAR),
f AS (SELECT l.k, n.src, 'fallback' AS how FROM l JOIN n ON n.key IS NULL AND l.c = n.c AND l.d = n.d AND l.p = n.p WHERE l.k NOT IN (SELECT k FROM m)),
x AS (SELECT * FROM m UNION ALL SELECT * FROM f)
SELECT k AS left_id, src AS right_id, how FROM x UNION ALL SELECT k, NULL, 'left_only' FROM l WHERE k NOT IN (SELECT k FROM x) UNION ALL SELECT NULL, src, 'right_only' FROM r WHERE src NOT IN (SELECT src FROM x)""")
def record_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two sides by id, by alias, else by their other fields; what stays alone is kept."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("p"))
    k = F.col("k")
    left = o.where(k % 3 != 0).withColumnRenamed("k", "left_id")
    rid = F.when(k % 7 == 0, F.concat(F.lit("x"), k)).when(k % 11 != 0, k.cast("string"))
    right = o.where(k % 5 != 0).select(k.alias("right_id"), rid.alias("rid"), "c", "d", "p")
    aliases = o.where(k % 14 == 0).select(F.concat(F.lit("x"), k).alias("rid"), k.alias("meant"))
    named = right.join(aliases, "rid", "left").withColumn("key", F.coalesce("meant", F.when(~F.col("rid").startswith("x"), F.col("rid").cast("long"))))
    sure = named.where("key IS NOT NULL").select("right_id", F.col("key").alias("left_id"), F.when(F.col("meant").isNotNull(), "alias").otherwise("id").alias("how"))
    sure = left.select("left_id").join(sure, "left_id").select("left_id", "right_id", "how")
    rest = left.join(sure.select("left_id"), "left_id", "left_anti").join(named.where("key IS NULL").select("right_id", "c", "d", "p"), ["c", "d", "p"])
    found = sure.unionByName(rest.select("left_id", "right_id", F.lit("fallback").alias("how")))
    alone = left.select("left_id").join(found.select("left_id"), "left_id", "left_anti").select("left_id", F.lit(None).cast("long").alias("right_id"), F.lit("left_only").alias("how"))
    other = right.select("right_id").join(found.select("right_id"), "right_id", "left_anti").select(F.lit(None).cast("long").alias("left_id"), "right_id", F.lit("right_only").alias("how"))
    return found.unionByName(alone).unionByName(other)


@query(f"""WITH s AS ({ORACLES["inverted_index_retrieval"]}), v AS ({ORACLES["cosine_topk"]}), l AS (SELECT doc_id, lang FROM documents),
j AS (SELECT coalesce(s.query, v.query) AS query, coalesce(s.found, v.found) AS found, coalesce(shared, 0) AS shared, similarity FROM s FULL JOIN v ON s.query = v.query AND s.found = v.found),
r AS (SELECT j.*, coalesce(a.lang = b.lang, false) AS structural FROM j LEFT JOIN l a ON a.doc_id = query LEFT JOIN l b ON b.doc_id = found)
SELECT query, found, shared, structural, row_number() OVER (PARTITION BY query ORDER BY structural DESC, shared DESC, coalesce(similarity, -2) DESC, found) AS place FROM r""")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse candidates with dense ones added, in one order: structural key, shared terms, similarity."""
    s = inverted_index_retrieval(spark, sf_dir).select("query", "found", "shared")
    v = cosine_topk(spark, sf_dir).select("query", "found", "similarity")
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    j = s.join(v, ["query", "found"], "full").withColumn("shared", F.coalesce("shared", F.lit(0)))
    j = j.join(lang.select(F.col("doc_id").alias("query"), F.col("lang").alias("a")), "query", "left").join(lang.select(F.col("doc_id").alias("found"), F.col("lang").alias("b")), "found", "left")
    r = j.withColumn("structural", F.coalesce(F.col("a") == F.col("b"), F.lit(False)))
    order = W.partitionBy("query").orderBy(F.desc("structural"), F.desc("shared"), F.desc(F.coalesce("similarity", F.lit(-2.0))), "found")
    return r.select("query", "found", "shared", "structural", F.row_number().over(order).cast("long").alias("place"))


WORDS4 = "\\p{L}{4,}"


@query(f"""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, text, list_distinct(regexp_extract_all(lower(text), '{WORDS4}')) AS w FROM conversations),
l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS ev FROM t),
g AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN role = 'system' THEN 'system' WHEN n < 40 THEN 'short' ELSE 'pass' END AS gate,
  CASE WHEN regexp_matches(text, '[?]') THEN 'question' WHEN regexp_matches(text, '[0-9]') THEN 'figure' WHEN regexp_matches(text, '{PURPOSE}') THEN 'purpose' ELSE 'statement' END AS kind,
  coalesce(len(list_intersect(w, ev)), 0) >= 2 AS in_context FROM l)
SELECT conv_id AS chat_id, turn AS pos, gate, kind, in_context, CASE WHEN gate = 'pass' THEN least(100, 20 + least(40, n // 20) + CASE kind WHEN 'figure' THEN 25 WHEN 'purpose' THEN 15 WHEN 'question' THEN 5 ELSE 0 END + CASE WHEN in_context THEN 10 ELSE 0 END) ELSE 0 END AS information FROM g""")
def information_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates, the kind of a turn, and points for its size, its kind and what it shares with the one before."""
    c = F.col("content")
    w = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORDS4), F.lit(0)))
    rows = turn_messages(spark, sf_dir).select("chat_id", "pos", "role", F.length(c).alias("n"), c, w.alias("w"))
    before = F.lag("w").over(W.partitionBy("chat_id").orderBy("pos"))
    kind = F.when(c.rlike("[?]"), "question").when(c.rlike("[0-9]"), "figure").when(c.rlike(PURPOSE), "purpose").otherwise("statement")
    gate = F.when(F.col("n") == 0, "empty").when(F.col("role") == "system", "system").when(F.col("n") < 40, "short").otherwise("pass")
    rows = rows.withColumn("shared", F.coalesce(F.size(F.array_intersect("w", before)), F.lit(0))).withColumns({"kind": kind, "gate": gate}).withColumn("in_context", F.col("shared") >= 2)
    by_kind = F.when(F.col("kind") == "figure", 25).when(F.col("kind") == "purpose", 15).when(F.col("kind") == "question", 5).otherwise(0)
    points = F.least(F.lit(100), 20 + F.least(F.lit(40), F.floor(F.col("n") / 20)) + by_kind + F.when(F.col("in_context"), 10).otherwise(0))
    return rows.select("chat_id", "pos", "gate", "kind", "in_context", F.when(F.col("gate") == "pass", points).otherwise(0).cast("long").alias("information"))


@query("""WITH t AS (SELECT conv_id, turn, text, list_sort(list_distinct(regexp_extract_all(lower(text), '\\p{L}{8,}')))[:3] AS keys FROM conversations)
SELECT conv_id AS chat_id, turn AS pos, regexp_matches(text, '(?i)^(?:hi|hello|hola|salut|hallo)(?:[^a-z]|$)') AS greeting, len(keys) = 0 AS context_only, array_to_string(keys, '|') AS topic_key FROM t""")
def topic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greeting, context only, or a key of a turn's first long words in order."""
    keys = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("\\p{L}{8,}"), F.lit(0)))), 1, 3)
    rows = turn_messages(spark, sf_dir).select("chat_id", "pos", F.col("content").rlike("(?i)^(?:hi|hello|hola|salut|hallo)(?:[^a-z]|$)").alias("greeting"), keys.alias("keys"))
    return rows.select("chat_id", "pos", "greeting", (F.size("keys") == 0).alias("context_only"), F.array_join("keys", "|").alias("topic_key"))


@query(f"""WITH {M}, sure AS (SELECT k FROM m WHERE kind = 'purchase' GROUP BY k HAVING count(DISTINCT chat_id) >= 2), own AS (SELECT DISTINCT chat_id, k FROM m WHERE kind = 'purchase'),
groups AS (SELECT chat_id FROM m GROUP BY chat_id HAVING count(DISTINCT k) >= 40)
SELECT row_id, CASE WHEN kind = 'purchase' THEN true WHEN kind = 'click' AND k IN (SELECT k FROM sure) THEN true
  WHEN kind = 'view' AND chat_id IN (SELECT chat_id FROM groups) AND EXISTS (SELECT 1 FROM own WHERE own.chat_id = m.chat_id AND own.k = m.k) THEN true WHEN kind = 'error' THEN NULL ELSE false END AS is_self FROM m""")
def self_attribution_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct rule across chats, and the rule of groups: in a chat of many senders one confirmed there
    is oneself in its other rows."""
    m = event_messages(spark, sf_dir).select("row_id", "chat_id", "kind", "k")
    bought = m.where("kind = 'purchase'")
    sure = bought.groupBy("k").agg(F.countDistinct("chat_id").alias("chats")).where("chats >= 2").select("k", F.lit(True).alias("sure"))
    own = bought.select("chat_id", "k", F.lit(True).alias("own")).distinct()
    groups = m.groupBy("chat_id").agg((F.countDistinct("k") >= 40).alias("is_group"))
    rows = m.join(sure, "k", "left").join(own, ["chat_id", "k"], "left").join(groups, "chat_id")
    kind = F.col("kind")
    side = F.when(kind == "purchase", True).when((kind == "click") & F.col("sure"), True).when((kind == "view") & F.col("is_group") & F.col("own"), True).when(kind == "error", None).otherwise(False)
    return rows.select("row_id", side.cast("boolean").alias("is_self"))


@query(f"""WITH {M} SELECT row_id, CASE WHEN kind = 'error' THEN 'from_self' WHEN kind NOT IN ('click', 'view', 'purchase') THEN 'type' WHEN value < 40 THEN 'no_rule' ELSE 'reply' END AS reason,
  CASE WHEN kind IN ('click', 'view', 'purchase') AND value >= 40 THEN substr(sha256('task|=' || row_id), 1, 20) END AS task_id FROM m""")
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages received as a stream, decided on, kept once, and queued as tasks where they want a reply."""
    return decision_stream(spark, sf_dir, uuid.uuid4().hex)
