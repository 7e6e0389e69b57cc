"""Claims, mentions, segmentation with state, clustering by anchors, model boundary, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.functions import profiles
from parley.functions import text as T
from parley.operators import overlaps, segments
from parley.operators.events import most_anchored
from parley.operators.graph import components
from parley.operators.mentions import claims as clause_claims
from parley.operators.mentions import mentions, typed_mentions
from parley.operators.ordered import Rule, ordered_groups, overlap_rule
from parley.operators.pairs import neighbours, placed
from parley.plans import scans
from parley.plans.analytics import MINUTE, SCORED, SIGNED, scored_documents, signed_pieces
from parley.plans.archive import DAY, M
from parley.plans.registry import query
from parley.sources.tables import event_messages, table, turn_messages
from parley.streaming.ingest import hourly_counts_stream, ingest_stream

HOUR = 60 * MINUTE
PERIOD_ROWS = 400


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[?]|%%%') THEN 'question' WHEN regexp_matches(text, '(?i)(?:^|[^a-z])(?:this|este|diese)(?:[^a-z]|$)') THEN 'opinion' WHEN regexp_matches(text, '(?i)(?:^|[^a-z])(?:are|sur)(?:[^a-z]|$)') THEN 'hypothesis' WHEN contains(text, '@') THEN 'personal' ELSE 'reported' END AS profile FROM documents""")
def claim_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    word = lambda w: t.rlike(f"(?i)(?:^|[^a-z])(?:{w})(?:[^a-z]|$)")
    profile = F.when(t.rlike("[?]|%%%"), "question").when(word("this|este|diese"), "opinion").when(word("are|sur"), "hypothesis").when(t.contains("@"), "personal").otherwise("reported")
    return table(spark, sf_dir, "documents").select("doc_id", profile.alias("profile"))


@query("""WITH p AS (SELECT source, CASE WHEN contains(text, '@') THEN 3 WHEN regexp_matches(text, '[0-9]{6,}') THEN 2 ELSE 1 END AS severity FROM documents) SELECT source, max(severity) AS severity, count(*) AS n FROM p GROUP BY source""")
def combined_claim_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster takes the most conservative profile of its members."""
    severity = F.when(F.col("text").contains("@"), 3).when(F.col("text").rlike("[0-9]{6,}"), 2).otherwise(1)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max(severity).alias("severity"), F.count("*").alias("n"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[|]') THEN 'table' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'legal' END, CASE WHEN regexp_matches(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') THEN 'network' END) AS domains FROM documents""")
def domain_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    tags = F.concat_ws(",", F.when(t.rlike("[|]"), "table"), F.when(t.contains("@"), "mail"), F.when(t.rlike("(?i)licen[sc]e"), "legal"), F.when(t.rlike("[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"), "network"))
    return table(spark, sf_dir, "documents").select("doc_id", tags.alias("domains"))


@query(f"""WITH {SCORED} SELECT doc_id, CASE WHEN n_chars < 40 THEN 'low_information' WHEN score >= 60 AND regexp_matches(text, '[0-9]') THEN 'reviewable' WHEN score >= 28 THEN 'context_needed' ELSE 'filtered' END AS assessment,
 CASE WHEN regexp_matches(text, '[?]|%%%') THEN least(62, least(100, 18 + least(30, n_chars // 3) + score // 2)) ELSE least(100, 18 + least(30, n_chars // 3) + score // 2) END AS information FROM s""")
def candidate_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a candidate, and its information score, capped where the wording is cautious."""
    s, t, n = F.col("score"), F.col("text"), F.col("n_chars")
    assessment = F.when(n < 40, "low_information").when((s >= 60) & t.rlike("[0-9]"), "reviewable").when(s >= 28, "context_needed").otherwise("filtered")
    points = F.least(F.lit(100), 18 + F.least(F.lit(30), F.floor(n / 3)) + F.floor(s / 2))
    return scored_documents(spark, sf_dir).select("doc_id", assessment.alias("assessment"), F.when(t.rlike("[?]|%%%"), F.least(F.lit(62), points)).otherwise(points).alias("information"))


@query("""SELECT conv_id AS chat_id, turn AS pos, length(text) > 0 AND role <> 'system' AND NOT regexp_matches(text, '^\\[(?:image|voice)') AS candidate, CASE WHEN length(text) < 30 THEN 'unclear' WHEN length(text) < 120 THEN 'partial' ELSE 'clear' END AS clarity FROM conversations""")
def text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return turn_messages(spark, sf_dir).select("chat_id", "pos", ((F.length(c) > 0) & (F.col("role") != "system") & ~c.rlike("^\\[(?:image|voice)")).alias("candidate"), F.when(F.length(c) < 30, "unclear").when(F.length(c) < 120, "partial").otherwise("clear").alias("clarity"))


@query()
def mention_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(table(spark, sf_dir, "documents"), "doc_id", "text")


ENTRIES = profiles.entries()
#: Values become marks that no text holds, then clauses are split and words are looked up.
CLAIM_WORDS = f"""v AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9-]{{1,63}}(?:\\.[A-Za-z0-9-]{{1,63}}){{1,8}}', ' § ', 'g'), '[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}', ' § ', 'g'),
  '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:[ T][0-9]{{2}}:[0-9]{{2}})?|[0-9]{{1,2}}:[0-9]{{2}})', ' ¶\\1¶ ', 'g'),
  '[0-9]+(?:[.,][0-9]+)? ?(?:%|kg|km|GB|MB|ms|EUR|USD)', ' ¤ ', 'g'), '[0-9]{{3,}}', ' ¤ ', 'g') AS t FROM documents),
c AS (SELECT doc_id, unnest(string_split_regex(t, '[.!?\\n]+')) AS part, generate_subscripts(string_split_regex(t, '[.!?\\n]+'), 1) - 1 AS clause FROM v),
k(word, class) AS (VALUES {", ".join(f"('{w}', '{c}')" for w, c in ENTRIES)}),
w AS (SELECT doc_id, clause, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT *, regexp_extract_all(part, '[\\p{{L}}\\p{{N}}_]+') AS words FROM c)),
l AS (SELECT w.*, k.class FROM w LEFT JOIN k ON k.word = lower(w.word)),
n AS (SELECT doc_id, clause, string_agg(DISTINCT lower(word), ',' ORDER BY lower(word)) FILTER (class IS NULL AND i > 1 AND regexp_matches(word, '^\\p{{Lu}}\\p{{Ll}}{{5,}}$')) AS names,
  lower(arg_max(word, (length(word), -i)) FILTER (class IS NULL AND regexp_matches(word, '^\\p{{L}}{{4,}}$'))) AS noun,
  min(CASE class {" ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(profiles.ACTIONS))} END) AS rank,
  coalesce(string_agg(DISTINCT class, ',' ORDER BY class) FILTER (class NOT IN ({", ".join(f"'{a}'" for a in profiles.ACTIONS)})), '') AS roles FROM l GROUP BY doc_id, clause)"""


@query(f"""WITH {CLAIM_WORDS} SELECT n.doc_id AS id, n.clause, [{", ".join(f"'{a}'" for a in profiles.ACTIONS)}][rank + 1] AS action, roles, coalesce(names, noun, '') AS targets,
  length(part) - length(replace(part, '§', '')) AS contacts, length(part) - length(replace(part, '¤', '')) AS amounts FROM n JOIN c USING (doc_id, clause) WHERE rank IS NOT NULL""")
def mention_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on mentions: each clause with a word that does something, what it does, its roles and whom it is about."""
    found = typed_mentions(table(spark, sf_dir, "documents"), "doc_id", "text", ENTRIES)
    return clause_claims(found, profiles.ACTIONS).drop("times")


@query("""SELECT o_orderkey AS row_id, epoch_us(TRY_CAST(CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'not a time' END AS TIMESTAMP)) AS us FROM orders""")
def parsed_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to instants; what can't be read is null, never the present."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, "not a time")
    at = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.unix_micros(at).alias("us"))


@query("""WITH w AS (SELECT o_orderkey AS row_id, concat_ws(chr(9), 'c' || o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END) AS line FROM orders), s AS (SELECT row_id, string_split(line, chr(9)) AS p FROM w)
SELECT row_id, CASE WHEN len(p) <> 3 THEN 'columns' WHEN p[2] NOT IN ('F', 'O') THEN 'status' WHEN NOT regexp_matches(p[1], '^c[0-9]+$') THEN 'handle' ELSE 'ok' END AS outcome FROM s""")
def tsv_wire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on the wire, checked for columns, enums and handles."""
    line = F.concat_ws("\t", F.concat(F.lit("c"), F.col("o_orderkey")), "o_orderstatus", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.split(line, "\t").alias("p"))
    outcome = F.when(F.size("p") != 3, "columns").when(~F.col("p")[1].isin("F", "O"), "status").when(~F.col("p")[0].rlike("^c[0-9]+$"), "handle").otherwise("ok")
    return p.select("row_id", outcome.alias("outcome"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey AND levenshtein(a.n_name, b.n_name) <= 6""")
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names a few edits apart within a scope."""
    n = table(spark, sf_dir, "nation")
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("other"), "n_regionkey")
    d = F.levenshtein("n_name", "other").cast("long")
    return n.join(b, "n_regionkey").where("n_nationkey < b").select(F.col("n_nationkey").alias("a"), "b", d.alias("distance")).where("distance <= 6")


@query("""WITH n AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{4,}'))) AS number FROM documents), f AS (SELECT number, count(*) AS docs FROM n GROUP BY number) SELECT doc_id, count(*) AS numbers, count(*) FILTER (docs > 1) AS supported FROM n JOIN f USING (number) GROUP BY doc_id""")
def number_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text that some other text states too."""
    n = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0)))).alias("number"))
    f = n.groupBy("number").agg(F.count("*").alias("docs"))
    return n.join(f, "number").groupBy("doc_id").agg(F.count("*").alias("numbers"), F.count_if(F.col("docs") > 1).alias("supported"))


def _termed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with small term sets: the tens and units of their payload, and their kind."""
    t = F.array(F.concat(F.lit("t"), F.floor(F.col("k") / 10)), F.concat(F.lit("u"), F.col("k") % 10), F.substring("kind", 1, 1))
    return event_messages(spark, sf_dir).select("chat_id", "us", "row_id", t.alias("terms"), F.when(F.col("kind") == "purchase", F.col("k") % 3).cast("long").alias("object"))


@query(scans.blocks(48 * HOUR))
def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.conversation_blocks(_termed(spark, sf_dir), 48 * HOUR)


@query(scans.strands(4))
def parallel_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.parallel_strands(_termed(spark, sf_dir))


@query(scans.bundles(6, 72 * HOUR))
def dialogue_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.dialogue_bundles(_termed(spark, sf_dir), 6, 72 * HOUR)


@query(scans.parents(3))
def bundle_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every local bundle that a message may belong to, by rank."""
    return segments.bundle_parents(_termed(spark, sf_dir), 3)


COLD = "l_quantity < 5"
SCALED = "count(*) AS fragments, min(fragment) AS first_fragment, max(fragment) AS last_fragment FROM f"
ONE = "1, fragment, fragment FROM f"


@query(f"""WITH f AS (SELECT l_suppkey AS chat_id, l_orderkey AS message_id, l_linenumber AS fragment, bool_or({COLD}) AS cold FROM lineitem GROUP BY ALL)
SELECT 'turn' AS scale, chat_id, message_id, {SCALED} GROUP BY chat_id, message_id UNION ALL SELECT 'session', chat_id, NULL, {SCALED} GROUP BY chat_id
UNION ALL SELECT 'micro', chat_id, message_id, {ONE} UNION ALL SELECT 'sparse', chat_id, message_id, {ONE} WHERE cold UNION ALL SELECT 'cold', chat_id, message_id, {ONE} WHERE cold""")
def bundle_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of fragments by scale; the local scale is ``dialogue_bundles`` and ``bundle_parents``."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("chat_id"), F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("fragment"), F.expr(COLD).alias("cold"))
    return segments.bundle_scales(rows)


SEGMENTS = f"""WITH {M}, g AS (SELECT *, us - lag(us) OVER w AS gap, k // 10 <> lag(k // 10) OVER w AS other, kind = 'signup' AS reply FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY us, row_id)),
b AS (SELECT *, CASE WHEN gap IS NULL THEN 'start' WHEN gap > {15 * HOUR} AND NOT reply THEN 'gap' WHEN other AND gap > {5 * HOUR} AND NOT reply THEN 'topic_shift' END AS boundary FROM g)"""


@query(SEGMENTS + " SELECT row_id, boundary, count(boundary) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS segment FROM b")
def dialogue_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by ordered rules: a gap unless replied to, a topic shift after a third of it."""
    order = W.partitionBy("chat_id").orderBy("us", "row_id")
    gap, topic, reply = F.col("us") - F.lag("us").over(order), F.floor(F.col("k") / 10), F.col("kind") == "signup"
    rows = event_messages(spark, sf_dir).withColumn("gap", gap).withColumn("other", topic != F.lag(topic).over(order))
    rows = rows.withColumn("boundary", F.when(F.col("gap").isNull(), "start").when((F.col("gap") > 15 * HOUR) & ~reply, "gap").when(F.col("other") & (F.col("gap") > 5 * HOUR) & ~reply, "topic_shift"))
    return rows.select("row_id", "boundary", F.count("boundary").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("segment"))


@query(f"""WITH {M}, d AS (SELECT chat_id, list_sort(list_distinct(list((us // {DAY})::BIGINT))) AS days FROM m WHERE kind = 'purchase' GROUP BY chat_id), r AS (SELECT max(us // {DAY})::BIGINT AS today FROM m)
SELECT chat_id, list_contains(days, today) AS today, list_contains(days, today - 1) AS yesterday, len(list_filter(days, lambda x: x > today - 7)) AS week_days, len(list_filter(days, lambda x: x <= today - 7)) AS outside FROM d, r""")
def time_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads seen today, yesterday and in the week, with the days outside of it."""
    m = event_messages(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    today = F.lit(m.agg(F.max("day")).first()[0])
    d = m.where("kind = 'purchase'").groupBy("chat_id").agg(F.collect_set("day").alias("days"))
    count = lambda f: F.size(F.filter("days", f)).cast("long")
    return d.select("chat_id", F.array_contains("days", today).alias("today"), F.array_contains("days", today - 1).alias("yesterday"), count(lambda x: x > today - 7).alias("week_days"), count(lambda x: x <= today - 7).alias("outside"))


@query(f"""WITH {M}, g AS (SELECT row_id AS greeting, min(CASE WHEN kind = 'purchase' THEN us END) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS topic_us, us, kind FROM m)
SELECT greeting, topic_us, CASE WHEN topic_us IS NULL THEN 'no_topic' WHEN topic_us - us > {24 * HOUR} THEN 'late' ELSE 'follows' END AS boundary FROM g WHERE kind = 'signup'""")
def greeting_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greetings and the first topic-bearing row after each."""
    later = W.partitionBy("chat_id").orderBy("us", "row_id").rowsBetween(1, W.unboundedFollowing)
    g = event_messages(spark, sf_dir).withColumn("topic_us", F.min(F.when(F.col("kind") == "purchase", F.col("us"))).over(later)).where("kind = 'signup'")
    return g.select(F.col("row_id").alias("greeting"), "topic_us", F.when(F.col("topic_us").isNull(), "no_topic").when(F.col("topic_us") - F.col("us") > 24 * HOUR, "late").otherwise("follows").alias("boundary"))


@query(f"""WITH {M}, d AS (SELECT chat_id, (us // {DAY})::BIGINT AS day, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, chat_id, day ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM d) SELECT chat_id, day, n, total FROM r WHERE total <= {PERIOD_ROWS}""")
def active_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole periods of a chat, the busiest first, until a cap of rows is full; chosen by metadata."""
    d = event_messages(spark, sf_dir).groupBy("chat_id", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.col("chat_id"), F.col("day")]
    top = d.orderBy(*order).limit(PERIOD_ROWS)  # a period has a row at least, so the cap holds no more
    return top.withColumn("total", F.sum("n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where(F.col("total") <= PERIOD_ROWS)


ANCHORS = """t AS (SELECT doc_id, source, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{11,}'))) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
a AS (SELECT * FROM df WHERE df BETWEEN 2 AND (SELECT greatest(8, least(24, round(0.08 * count(*)))) FROM documents))"""


@query(f"""WITH {ANCHORS} SELECT lang AS domain, term AS anchor, count(*) AS members, count(DISTINCT source) AS chats, min(doc_id) AS lead, least(100, 40 + 10 * count(*) + 5 * count(DISTINCT source)) AS quality
FROM t JOIN a USING (term) GROUP BY ALL HAVING count(*) >= 2""")
def anchor_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event proposals: documents of a domain that share a term which is neither unique nor common. The most
    documents that a term may have follow the number of all."""
    return _proposals(spark, sf_dir, most_anchored(table(spark, sf_dir, "documents").count()))


@query(f"""WITH RECURSIVE {ANCHORS}, x AS (SELECT lang, term, doc_id FROM t JOIN a USING (term)),
e AS (SELECT p.doc_id AS a, q.doc_id AS b FROM x p JOIN x q ON p.lang = q.lang AND p.term = q.term AND p.doc_id <> q.doc_id GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT a AS i, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.i) SELECT i AS doc_id, min(c) AS event_id FROM r GROUP BY i""")
def anchor_event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by three rare anchors or more. An anchor has at most 24 documents, so pairs
    within it are few."""
    return _event_clusters(spark, sf_dir, most_anchored(table(spark, sf_dir, "documents").count()))


def _proposals(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.explode(T.terms(F.col("text"), 11)).alias("term"))
    a = t.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(2, most)).select("term")
    p = t.join(a, "term").groupBy(F.col("lang").alias("domain"), F.col("term").alias("anchor")).agg(F.count("*").alias("members"), F.countDistinct("source").alias("chats"), F.min("doc_id").alias("lead")).where("members >= 2")
    return p.withColumn("quality", F.least(F.lit(100), 40 + 10 * F.col("members") + 5 * F.col("chats")))


def _event_clusters(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(T.terms(F.col("text"), 11)).alias("term"))
    a = t.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(2, most)).select("term")
    g = t.join(a, "term").groupBy("lang", "term").agg(F.array_sort(F.collect_list("doc_id")).alias("d")).where(F.size("d") > 1)
    pairs = F.flatten(F.transform("d", lambda x, i: F.transform(F.slice(F.col("d"), i + 2, F.size("d")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    e = g.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where("n >= 3")
    return components(e.select("a", "b")).select(F.col("id").alias("doc_id"), F.col("root").alias("event_id"))


@query(f"""WITH {SIGNED}, u AS (SELECT source, sig, count(*) AS uses, count(DISTINCT doc_id) AS texts, count(DISTINCT lang) AS langs, min(doc_id) AS first_doc
  FROM b WHERE length(sig) BETWEEN 3 AND 36 GROUP BY ALL HAVING count(*) >= 2),
o AS (SELECT sig, count(DISTINCT source) AS chats FROM b WHERE length(sig) BETWEEN 3 AND 36 GROUP BY sig),
c AS (SELECT source AS chat, sig, uses, texts, chats, first_doc, least(95, 30 + 8 * uses + 6 * texts - 4 * greatest(chats - 3, 0)) AS confidence FROM u JOIN o USING (sig))
SELECT * FROM c WHERE confidence >= 55 ORDER BY confidence DESC, uses DESC, chat, sig LIMIT 40""")
def meme_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that a chat repeats, less sure where every chat does; the best forty."""
    p = signed_pieces(spark, sf_dir)
    u = p.groupBy("source", "sig").agg(F.count("*").alias("uses"), F.countDistinct("doc_id").alias("texts"), F.min("doc_id").alias("first_doc"))
    chats = u.groupBy("sig").agg(F.count("*").alias("chats"))
    c = u.where("uses >= 2").join(chats, "sig").withColumnRenamed("source", "chat")
    points = 30 + 8 * F.col("uses") + 6 * F.col("texts") - 4 * F.greatest(F.col("chats") - 3, F.lit(0))
    c = c.withColumn("confidence", F.least(F.lit(95), points)).where("confidence >= 55")
    return c.orderBy(F.desc("confidence"), F.desc("uses"), "chat", "sig").limit(40)


@query("""WITH r AS (SELECT l_orderkey AS lead, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey), e AS (SELECT DISTINCT l_orderkey AS lead, l_suppkey AS ref FROM lineitem),
p AS (SELECT a.lead AS a, b.lead AS b, count(*) AS shared FROM e a JOIN e b ON a.ref = b.ref AND a.lead <> b.lead WHERE a.lead % 20 = 0 GROUP BY 1, 2)
SELECT a, b, shared FROM p JOIN r x ON x.lead = a JOIN r y ON y.lead = b WHERE shared >= (least(x.n, y.n) + 1) // 2""")
def citation_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads whose citations overlap those of a queried lead by half of the smaller set, rounded up. The
    queries are the leads whose id 20 divides, against all leads; ``citation_groups`` groups all."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    return overlaps.citation_overlaps(rows.select(F.col("l_orderkey").alias("lead"), F.col("l_suppkey").alias("ref")), 20)


@query()
def citation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leads in greedy groups by overlapping citations: a lead joins the first group that shares half
    of the smaller of both reference sets, rounded up."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.collect_set("l_suppkey").alias("refs"))
    return ordered_groups(r, overlap_rule(50)).withColumnRenamed("pos", "lead")


@query("""SELECT sha256(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS claim, count(*) AS merged, min(doc_id) AS first_doc, count(DISTINCT source) AS refs FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), 256).alias("claim"))
    return d.groupBy("claim").agg(F.count("*").alias("merged"), F.min("doc_id").alias("first_doc"), F.countDistinct("source").alias("refs")).where("merged > 1")


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.n_chars > 400)")
def unrepresented_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").where("n_chars > 400").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("""SELECT count(*) AS n_rows, bit_xor(('0x' || substr(sha256(doc_id || '|' || source || '|' || coalesce(text, '')), 1, 15))::BIGINT) AS replay_hash FROM documents""")
def replay_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of a projection, equal for equal rows in any order."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "doc_id", "source", F.coalesce("text", F.lit(""))), 256), 1, 15), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("replay_hash"))


@query(f"""WITH {SCORED}, j AS (SELECT s.doc_id, s.source, s.score, quality, toxic FROM s JOIN labels USING (doc_id)) SELECT doc_id, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 0 THEN 'low_quality' WHEN score < 28 THEN 'no_evidence' ELSE 'selected' END AS decision FROM j""")
def query_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection without a top-k: each rejection has a reason."""
    j = scored_documents(spark, sf_dir).select("doc_id", "score").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.select("doc_id", F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 0, "low_quality").when(F.col("score") < 28, "no_evidence").otherwise("selected").alias("decision"))


@query(f"""WITH {SCORED}, r AS (SELECT doc_id, source, lang, score, n_chars, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS by_score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS by_size FROM s)
SELECT lang, doc_id, by_score <= 2 AS for_score, by_size <= 4 AS for_size FROM r WHERE by_score <= 2 OR by_size <= 4""")
def feature_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of each feature within quotas. Salted parts send on only what can be among the best."""
    s = scored_documents(spark, sf_dir).select("doc_id", "lang", "score", "n_chars")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    best = lambda c, by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc(c), "doc_id"))
    part = s.withColumn("salt", salt).withColumn("a", best("score", ["lang", "salt"])).withColumn("b", best("n_chars", ["lang", "salt"])).where("a <= 2 OR b <= 4")
    r = part.withColumn("a", best("score", ["lang"])).withColumn("b", best("n_chars", ["lang"])).where("a <= 2 OR b <= 4")
    return r.select("lang", "doc_id", (F.col("a") <= 2).alias("for_score"), (F.col("b") <= 4).alias("for_size"))


@query("""WITH a AS (SELECT doc_id, quality AS v FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS v FROM labels WHERE doc_id % 5 <> 0), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.v AS va, b.v AS vb FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT doc_id, CASE WHEN va = vb THEN va WHEN va IS NULL OR vb IS NULL THEN coalesce(va, vb) WHEN doc_id % 2 = 0 THEN va END AS merged, va IS DISTINCT FROM vb AND va IS NOT NULL AND vb IS NOT NULL AND doc_id % 2 = 1 AS unresolved FROM j""")
def adjudicated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators merged with adjudications (here of even ids, for the first); the rest is open."""
    l, i = table(spark, sf_dir, "labels"), F.col("doc_id")  # noqa: E741
    a = l.where(i % 3 != 0).select("doc_id", F.col("quality").alias("va"))
    b = l.where(i % 5 != 0).select("doc_id", F.when(i % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("vb"))
    va, vb = F.col("va"), F.col("vb")
    j = a.join(b, "doc_id", "full")
    merged = F.when(va == vb, va).when(va.isNull() | vb.isNull(), F.coalesce(va, vb)).when(i % 2 == 0, va)
    return j.select("doc_id", merged.alias("merged"), (F.coalesce(va != vb, F.lit(False)) & (i % 2 == 1)).alias("unresolved"))


@query(f"""WITH {M}, s AS (SELECT chat_id, count(*) AS n, count(DISTINCT (us // {DAY})) AS days, count(DISTINCT kind) AS kinds FROM m GROUP BY chat_id) SELECT sum(n)::BIGINT AS candidates, count(*) AS packages, round(sum(n) / nullif(count(*), 0), 4) AS compression, round(count(*) FILTER (kinds >= 5) / nullif(count(*), 0), 4) AS cue_coverage FROM s""")
def scheduler_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"))
    part = lambda x, y: F.round(x / F.nullif(y, F.lit(0)), 4)
    return s.agg(F.sum("n").alias("candidates"), F.count("*").alias("packages"), part(F.sum("n"), F.count("*")).alias("compression"), part(F.count_if(F.col("kinds") >= 5), F.count("*")).alias("cue_coverage"))


@query(f"""WITH {M}, p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m) SELECT a.row_id, b.row_id AS previous, b.us >= a.us - {12 * HOUR} AND (a.kind = b.kind OR a.k // 10 = b.k // 10) AS continues FROM p a JOIN p b ON a.chat_id = b.chat_id AND a.pos = b.pos + 1""")
def local_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = neighbours(placed(event_messages(spark, sf_dir)).select("chat_id", "row_id", "us", "kind", "k", "pos"), 1)
    near = F.col("a_us") >= F.col("b_us") - 12 * HOUR
    return x.select(F.col("b_row_id").alias("row_id"), F.col("a_row_id").alias("previous"), (near & ((F.col("a_kind") == F.col("b_kind")) | (F.floor(F.col("a_k") / 10) == F.floor(F.col("b_k") / 10)))).alias("continues"))


@query(f"""WITH {SCORED} SELECT source AS story, lang AS chat, count(*) AS cards, max(score) AS best, arg_max(doc_id, (score, -doc_id)) AS quote FROM s WHERE score >= 28 GROUP BY ALL""")
def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes by story and chat."""
    s = scored_documents(spark, sf_dir).where("score >= 28")
    return s.groupBy(F.col("source").alias("story"), F.col("lang").alias("chat")).agg(F.count("*").alias("cards"), F.max("score").alias("best"), F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("quote"))


@query("""WITH f AS (SELECT conv_id, turn, 'm' || turn AS handle, text FROM conversations), g AS (SELECT conv_id, count(*) AS allowed FROM f WHERE turn % 2 = 0 GROUP BY conv_id) SELECT f.conv_id AS packet, f.handle, CASE WHEN turn % 2 <> 0 THEN 'outside_evidence' WHEN length(text) < 20 THEN 'too_short' ELSE 'accepted' END AS outcome FROM f""")
def model_finding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may have returned, bound to the handles it was given: an injected callable runs in
    Arrow batches, and its output is validated by rules."""
    from parley.operators.model import apply_model

    answers = apply_model(turn_messages(spark, sf_dir).select("chat_id", "pos", "content"), lambda texts: [len(t) for t in texts])
    outcome = F.when(F.col("pos") % 2 != 0, "outside_evidence").when(F.col("answer") < 20, "too_short").otherwise("accepted")
    return answers.select(F.col("chat_id").alias("packet"), F.concat(F.lit("m"), F.col("pos")).alias("handle"), outcome.alias("outcome"))


@query(f"WITH {M} SELECT (us // {HOUR})::BIGINT AS hour, kind, count(*) AS n, max(row_id) AS last_row FROM m GROUP BY ALL")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling event-time counts by a stream over the events file, run to its end."""
    return hourly_counts_stream(spark, sf_dir, uuid.uuid4().hex)


@query("SELECT event_type AS kind, count(DISTINCT event_id) AS messages, max(event_id) AS watermark FROM events GROUP BY event_type")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events received as a stream, deduplicated and appended batch by batch."""
    rows = ingest_stream(spark, sf_dir, uuid.uuid4().hex)
    return rows.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("messages"), F.max("event_id").alias("watermark"))
