"""Rule analytics: predicates, scoring, aggregates, sessions, selection."""

from __future__ import annotations

import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.functions import text as T
from parley.operators.islands import adaptive_cutoffs, balanced_chunks, capped_packets, carried, gap_sessions
from parley.plans import scans
from parley.plans.archive import DAY, START, M
from parley.plans.registry import query
from parley.sources.tables import between, event_messages, table, turn_messages
from parley.streaming.state import cooldown_decisions

MINUTE = 60_000_000
P = T.TEST_PROFILE


def _sql_score(text: str) -> str:
    return f"least(100, CASE WHEN length({text}) >= 24 THEN 10 ELSE 0 END + " + " + ".join("CASE WHEN regexp_matches({}, '{}') THEN {} ELSE 0 END".format(text, p, n) for p, n in P.weights.values()) + ")"


SCORED = f"s AS (SELECT doc_id, source, lang, text, n_chars, CASE WHEN regexp_matches(text, '{P.decision_only}') THEN least(24, {_sql_score('text')}) ELSE {_sql_score('text')} END AS score FROM documents)"


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = T.classes_met(F.col("text"), P)
    return table(spark, sf_dir, "documents").withColumn("met", met).withColumn("score", T.message_score(F.col("text"), P, F.col("met")))


@query(f"""WITH {M} SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS local_day, count(*) AS n FROM m WHERE us >= {START + DAY - 8 * 3_600_000_000} AND us < {START + 8 * DAY - 8 * 3_600_000_000} GROUP BY 1""")
def local_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive local dates as a half-open range of UTC instants, cut by Shanghai's days."""
    zone = ZoneInfo("Asia/Shanghai")
    low, high = (int(datetime.datetime(2024, 1, d, tzinfo=zone).timestamp()) * 1_000_000 for d in (2, 9))
    m = between(event_messages(spark, sf_dir), low, high)
    day = F.date_format(F.expr("ts + INTERVAL 8 HOUR"), "yyyy-MM-dd")
    return m.groupBy(day.alias("local_day")).agg(F.count("*").alias("n"))


@query(f"""WITH {M}, f AS (SELECT row_id, unnest([{{'n': 'all', 'b': true}}, {{'n': 'inbound', 'b': kind <> 'error'}}, {{'n': 'media', 'b': kind = 'view'}}, {{'n': 'high_signal', 'b': value >= 50}}, {{'n': 'attention', 'b': kind <> 'error' AND value >= 80}}]) AS f FROM m)
SELECT f.n AS filter, count(*) FILTER (f.b) AS n FROM f GROUP BY f.n""")
def feed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every feed filter in one pass."""
    kind, value = F.col("kind"), F.col("value")
    tests = {"all": F.lit(True), "inbound": kind != "error", "media": kind == "view", "high_signal": value >= 50, "attention": (kind != "error") & (value >= 80)}
    sums = event_messages(spark, sf_dir).agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return sums.unpivot([], list(tests), "filter", "n")


RULES = "(1, ['click', 'view'], 10, 40, 540, 1080), (2, ['purchase'], 0, 100, 1320, 360), (3, ['error', 'signup'], 50, 100, 0, 1440)"


@query(f"""WITH {M}, r(rule, kinds, lo, hi, t0, t1) AS (VALUES {RULES}), x AS (SELECT row_id, chat_id, us, rule FROM m JOIN r ON list_contains(kinds, kind) AND value >= lo AND value < hi
 AND CASE WHEN t0 <= t1 THEN (us // {MINUTE}) % 1440 >= t0 AND (us // {MINUTE}) % 1440 < t1 ELSE (us // {MINUTE}) % 1440 >= t0 OR (us // {MINUTE}) % 1440 < t1 END)
SELECT row_id, min(rule) AS first_rule, count(*) AS n_rules FROM x GROUP BY row_id""")
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are a table: type lists, ranges, and clock ranges that may wrap midnight; the first match wins."""
    rules = spark.createDataFrame([(1, ["click", "view"], 10, 40, 540, 1080), (2, ["purchase"], 0, 100, 1320, 360), (3, ["error", "signup"], 50, 100, 0, 1440)], "rule int, kinds array<string>, lo int, hi int, t0 int, t1 int")
    by_kind = rules.withColumn("kind", F.explode("kinds"))  # an equi-join on the type
    at = F.pmod(F.floor(F.col("us") / MINUTE), F.lit(1440))
    clock = F.when(F.col("t0") <= F.col("t1"), (at >= F.col("t0")) & (at < F.col("t1"))).otherwise((at >= F.col("t0")) | (at < F.col("t1")))
    hits = event_messages(spark, sf_dir).join(F.broadcast(by_kind), "kind").where((F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi")) & clock)
    return hits.groupBy("row_id").agg(F.min("rule").alias("first_rule"), F.count("*").alias("n_rules"))


@query(scans.cooldown(f"{M}, t AS (SELECT chat_id, us, row_id, value >= 40 AS wants, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m)", 6 * 60 * MINUTE, "SELECT row_id, decision FROM s"))
def reply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with a cooldown of a chat: a reply suppresses those in the next 6 hours. The state is
    the time of the last reply, so it is a stateful scan of each chat."""
    return cooldown_decisions(event_messages(spark, sf_dir), candidate=F.col("value") >= 40, cooldown_us=6 * 60 * MINUTE)


@query("""SELECT c_custkey AS sender_id, regexp_matches(c_name, '^(?:[a-z]+_id_|[0-9]+$)') AS internal, CASE WHEN regexp_matches(c_name, '^(?:[a-z]+_id_|[0-9]+$)') THEN 'contact ' || c_custkey ELSE c_name END AS label,
 c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 750 AS resolved FROM customer""")
def sender_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names: internal ids are no names. An identity is resolved by a trusted source and confidence."""
    internal = F.col("c_name").rlike("^(?:[a-z]+_id_|[0-9]+$)")
    label = F.when(internal, F.concat(F.lit("contact "), F.col("c_custkey"))).otherwise(F.col("c_name"))
    resolved = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") >= 750)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sender_id"), internal.alias("internal"), label.alias("label"), resolved.alias("resolved"))


def _sql_redact(text: str) -> str:
    for name, pattern in T.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


@query(f"SELECT doc_id, sha256({_sql_redact('text')}) AS redacted_sha FROM documents")
def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.sha2("text", 256).alias("redacted_sha"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) > 40 THEN substr(trim(text), 1, 39) || '…' ELSE trim(text) END AS clip, (octet_length(encode(text)) + 3) // 4 AS tokens FROM documents")
def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 40).alias("clip"), T.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH t AS (SELECT doc_id, regexp_extract(text, '^[^.\\n]*', 0) AS title FROM documents)
SELECT doc_id, length(title) BETWEEN 7 AND 24 AND NOT regexp_matches(lower(title), '^(?:the|and|of)\\b') AND NOT regexp_matches(lower(title), '(?:of|the|de)$') AS valid FROM t""")
def editorial_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences as titles: 7 to 24 characters, no weak beginning or ending."""
    title = F.regexp_extract("text", "^[^.\\n]*", 0)
    low = F.lower(title)
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(title).between(7, 24) & ~low.rlike("^(?:the|and|of)\\b") & ~low.rlike("(?:of|the|de)$")).alias("valid"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def body_free_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata without bodies, by an allow-list held against the schema when the plan is made."""
    d, allowed = table(spark, sf_dir, "documents"), ("doc_id", "lang", "source", "n_chars")
    out = d.select(*[c for c in d.columns if c in allowed])
    if {"text", "html", "content"} & set(out.columns):
        raise ValueError("a body column is left")
    return out


@query(f"""WITH {SCORED} SELECT doc_id, CASE WHEN score >= 60 THEN 'immediate' WHEN regexp_matches(text, '[0-9]{{6,}}') THEN 'pending_context' WHEN score > 0 THEN 'background' ELSE 'cold_recoverable' END AS channel,
 concat_ws(',', CASE WHEN score >= 60 THEN 'score' END, CASE WHEN regexp_matches(text, '[0-9]{{6,}}') THEN 'number' END, CASE WHEN n_chars < 100 THEN 'short' END) AS reasons FROM s""")
def semantic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing by the first rule that fits, with all reasons."""
    score, number = F.col("score"), F.col("text").rlike("[0-9]{6,}")
    channel = F.when(score >= 60, "immediate").when(number, "pending_context").when(score > 0, "background").otherwise("cold_recoverable")
    reasons = F.concat_ws(",", F.when(score >= 60, "score"), F.when(number, "number"), F.when(F.col("n_chars") < 100, "short"))
    return scored_documents(spark, sf_dir).select("doc_id", channel.alias("channel"), reasons.alias("reasons"))


@query("SELECT doc_id, substr(sha256('doc|' || coalesce('=' || source, '-') || '|' || coalesce('=' || lang, '-') || '|' || coalesce('=' || n_chars, '-')), 1, 20) AS fingerprint, text IS NOT NULL AND lang IS NOT NULL AS complete FROM documents")
def registry_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_id("doc", F.col("source"), F.col("lang"), F.col("n_chars")).alias("fingerprint"), (F.col("text").isNotNull() & F.col("lang").isNotNull()).alias("complete"))


@query(f"WITH {SCORED} SELECT doc_id, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 28 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'excluded' END AS level, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, (p, _) in sorted(P.weights.items())) + ") AS reasons FROM s")
def message_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir).select("doc_id", "score", T.score_level(F.col("score")).alias("level"), F.array_join("met", ",").alias("reasons"))


@query(f"""WITH b AS (SELECT doc_id, text, regexp_replace(text, '[\\s[:punct:]]', '', 'g') AS bare FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '{P.media}') THEN 'media' WHEN bare = '' THEN 'reaction' WHEN regexp_matches(text, '{P.greeting}') THEN 'greeting' WHEN regexp_matches(text, '{P.acknowledgement}') THEN 'acknowledgement'
 WHEN length(text) < 24 THEN 'context_fragment' WHEN length(bare) < 40 THEN 'low_information' ELSE 'none' END AS class FROM b""")
def message_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.recognition(F.col("text"), P).alias("class"))


SIGNED = """p AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '[^.\\n]+')) AS piece FROM documents),
b AS (SELECT doc_id, source, lang, regexp_replace(regexp_replace(regexp_replace(lower(piece), 'https?://\\S+', '', 'g'), '\\[[a-z]+\\]', '', 'g'), '[^a-z0-9]', '', 'g') AS sig FROM p)"""


def signed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, sig of every piece of a text that is short enough to be repeated as one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.explode(F.regexp_extract_all("text", F.lit("[^.\\n]+"), F.lit(0))).alias("piece"))
    return d.select("doc_id", "source", "lang", T.meme_signature(F.col("piece")).alias("sig")).where("sig IS NOT NULL")


@query(f"WITH {SIGNED} SELECT sig, count(*) AS n, min(doc_id) AS first_doc FROM b WHERE length(sig) BETWEEN 3 AND 36 GROUP BY sig HAVING count(*) >= 2")
def meme_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures that pieces of texts share."""
    return signed_pieces(spark, sf_dir).groupBy("sig").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n >= 2")


@query("WITH t AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS term FROM documents) SELECT term, count(*) AS df, count(DISTINCT source) AS sources FROM t GROUP BY term HAVING count(*) >= 2")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("source", F.explode(T.terms(F.col("text"))).alias("term"))
    by = t.groupBy("term", "source").agg(F.count("*").alias("n"))
    return by.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("sources")).where("df >= 2")


@query("""WITH c AS (SELECT conv_id AS chat_id, turn AS pos, unnest(string_split_regex(text, '[.!?\\n]+\\s*')) AS clause, generate_subscripts(string_split_regex(text, '[.!?\\n]+\\s*'), 1) AS i FROM conversations)
SELECT chat_id, pos, count(*) AS clauses, sum(length(clause))::BIGINT AS chars, arg_max(clause, (length(clause), -i)) AS longest FROM c WHERE clause <> '' GROUP BY ALL""")
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = turn_messages(spark, sf_dir).select("chat_id", "pos", F.posexplode(F.split("content", "[.!?\\n]+\\s*")).alias("i", "clause")).where("clause <> ''")
    return c.groupBy("chat_id", "pos").agg(F.count("*").alias("clauses"), F.sum(F.length("clause")).alias("chars"), F.max_by("clause", F.struct(F.length("clause"), -F.col("i"))).alias("longest"))


@query(f"""WITH {M} SELECT count(*) AS messages, count(*) FILTER (kind <> 'error') AS inbound, count(*) FILTER (kind = 'view') AS media, (count(*) FILTER (k % 3 = 0) * 1000 + count(*) // 2) // greatest(count(*), 1) AS unknown_permille,
 CASE WHEN count(*) FILTER (kind = 'nothing') = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS voice_coverage, count(DISTINCT chat_id) AS chats FROM m""")
def workbench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One global aggregate; an empty denominator has a fixed default."""
    kind, n = F.col("kind"), F.count("*")
    share = ((F.count_if(F.col("k") % 3 == 0) * 1000 + F.floor(n / 2)) / F.greatest(n, F.lit(1))).cast("long")
    return event_messages(spark, sf_dir).agg(
        n.alias("messages"), F.count_if(kind != "error").alias("inbound"), F.count_if(kind == "view").alias("media"), share.alias("unknown_permille"),
        F.when(F.count_if(kind == "nothing") == 0, 1.0).otherwise(0.0).alias("voice_coverage"), F.countDistinct("chat_id").alias("chats"),
    )


@query(f"""WITH {M}, h AS (SELECT (us // 3600000000 + 8) % 24 AS hour, count(*) AS n, count(*) FILTER (kind = 'view') AS media FROM m GROUP BY 1)
SELECT g.hour, coalesce(n, 0) AS n, coalesce(media, 0) AS media FROM (SELECT unnest(range(0, 24)) AS hour) g LEFT JOIN h USING (hour)""")
def hourly_histogram_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 local hours, those without messages too."""
    hour = F.pmod(F.floor(F.col("us") / 3_600_000_000) + 8, F.lit(24))
    h = event_messages(spark, sf_dir).groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "view").alias("media"))
    return spark.range(24).select(F.col("id").alias("hour")).join(F.broadcast(h), "hour", "left").fillna(0)


@query(f"WITH {M} SELECT chat_id, count(*) AS messages, count(*) FILTER (value >= 50) AS high_value, count(DISTINCT kind) AS kinds, count(DISTINCT k) AS participants FROM m GROUP BY chat_id ORDER BY messages DESC, chat_id LIMIT 12")
def chat_rollup_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("messages"), F.count_if(F.col("value") >= 50).alias("high_value"), F.countDistinct("kind").alias("kinds"), F.countDistinct("k").alias("participants"))
    return c.orderBy(F.desc("messages"), "chat_id").limit(12)


@query("""WITH v AS (SELECT o_custkey AS key, o_orderpriority AS name, count(*) AS n, max(o_orderdate) AS last_seen, max(o_orderkey) AS last_row FROM orders GROUP BY ALL)
SELECT key, arg_max(name, (name = '1-URGENT', n, last_seen, last_row)) AS name, sum(n)::BIGINT AS messages, count(*) AS names, substr(sha256('contact|=' || key), 1, 16) AS contact_id FROM v GROUP BY key""")
def best_name_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts: the name by priority, count and time, from counts by name."""
    o = table(spark, sf_dir, "orders")
    v = o.groupBy(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("t"), F.max("o_orderkey").alias("r"))
    best = F.max_by("name", F.struct(F.col("name") == "1-URGENT", "n", "t", "r"))
    return v.groupBy("key").agg(best.alias("name"), F.sum("n").alias("messages"), F.count("*").alias("names")).withColumn("contact_id", F.substring(T.stable_id("contact", F.col("key")), 1, 16))


@query(f"WITH {M} SELECT kind, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(row_id)) AS place FROM m GROUP BY kind")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type, most common first, ties by first seen. The ranked rows are one a type."""
    c = event_messages(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    return c.select("kind", "n", F.row_number().over(W.orderBy(F.desc("n"), "first")).cast("long").alias("place"))


@query(f"""WITH {SCORED}, t AS (SELECT doc_id, source, score, unnest(list_filter(['with', 'the', 'les', 'und', 'los'], lambda w: contains(lower(text), ' ' || w || ' '))) AS topic FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS n FROM t)
SELECT topic, count(*) AS n, count(DISTINCT source) AS chats, sum(score)::BIGINT AS score_sum, string_agg(doc_id::VARCHAR, ',' ORDER BY n) FILTER (n <= 3) AS evidence FROM r GROUP BY topic""")
def topic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by topic, with the three best as evidence. Every (topic, source) keeps its own three
    first, so no topic is ranked in one task."""
    low = F.lower("text")
    topics = F.array_compact(F.array(*[F.when(low.contains(f" {w} "), F.lit(w)) for w in ("with", "the", "les", "und", "los")]))
    t = scored_documents(spark, sf_dir).select("doc_id", "source", "score", F.explode(topics).alias("topic"))
    part = W.partitionBy("topic", "source", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(F.desc("score"), "doc_id")
    best = t.withColumn("n", F.row_number().over(part)).where("n <= 3").groupBy("topic").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))), 1, 3).alias("b"))
    by = t.groupBy("topic", "source").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    sums = by.groupBy("topic").agg(F.sum("n").alias("n"), F.count("*").alias("chats"), F.sum("s").alias("score_sum"))
    return sums.join(best, "topic").select("topic", "n", "chats", "score_sum", F.array_join(F.transform("b", lambda x: x["doc_id"].cast("string")), ",").alias("evidence"))


@query(f"""WITH {SCORED} SELECT source, count(*) AS n, least(100, sum(score)::BIGINT // count(*) + least(10, count(*) // 20) + least(8, 2 * count(DISTINCT lang)) + CASE WHEN bool_or(regexp_matches(text, '[0-9]{{3,}}')) THEN 6 ELSE 0 END) AS insight FROM s GROUP BY source""")
def primary_insight_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    mean = F.floor(F.sum("score") / n)
    bonus = F.least(F.lit(10), F.floor(n / 20)) + F.least(F.lit(8), 2 * F.countDistinct("lang")) + F.when(F.bool_or(F.col("text").rlike("[0-9]{3,}")), 6).otherwise(0)
    return scored_documents(spark, sf_dir).groupBy("source").agg(n.alias("n"), F.least(F.lit(100), mean + bonus).alias("insight"))


def _session_sql(minutes: int) -> str:
    return f"""WITH {M}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY chat_id ORDER BY us, row_id) > {minutes * MINUTE} THEN 1 ELSE 0 END AS new FROM m),
i AS (SELECT *, sum(new) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) """


SESSION_SUMS = "SELECT chat_id, session, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM i GROUP BY chat_id, session"


def _sessions(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    return gap_sessions(event_messages(spark, sf_dir), minutes).groupBy("chat_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@query(_session_sql(45) + SESSION_SUMS)
def gap_sessions_45m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, 45)


@query(_session_sql(90) + SESSION_SUMS)
def gap_sessions_90m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, 90)


@query(_session_sql(2880) + """, n AS (SELECT *, count(*) OVER (PARTITION BY chat_id, session) AS n, row_number() OVER (PARTITION BY chat_id, session ORDER BY us, row_id) - 1 AS j FROM i), c AS (SELECT *, (n + 11) // 12 AS parts FROM n),
x AS (SELECT chat_id, session, CASE WHEN j < (n % parts) * (n // parts + 1) THEN j // (n // parts + 1) ELSE n % parts + (j - (n % parts) * (n // parts + 1)) // (n // parts) END AS chunk, row_id FROM c WHERE n >= 5 * parts)
SELECT chat_id, session, chunk, count(*) AS n, min(row_id) AS first_row FROM x GROUP BY ALL""")
def balanced_session_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a two-day gap, cut into chunks of 5 to 12 rows."""
    rows = balanced_chunks(gap_sessions(event_messages(spark, sf_dir), 2880), 5, 12)
    return rows.groupBy("chat_id", "session", "chunk").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query(_session_sql(720) + """, p AS (SELECT *, (row_number() OVER (PARTITION BY chat_id, session ORDER BY us, row_id) - 1) // 4 AS packet FROM i)
SELECT chat_id, session, packet, count(*) AS n, substr(sha256('packet|=' || chat_id || '|=' || session || '|=' || packet), 1, 20) AS packet_id FROM p GROUP BY ALL""")
def dialogue_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capped_packets(event_messages(spark, sf_dir), 720, 4).groupBy("chat_id", "session", "packet").agg(F.count("*").alias("n"))
    return rows.withColumn("packet_id", T.stable_id("packet", F.col("chat_id"), F.col("session"), F.col("packet")))


@query(_session_sql(720) + """SELECT chat_id, session, count(*) AS n, max(k) AS top_score, least(100, max(k) + least(40, 8 * count(*))) AS importance, arg_min(row_id, (us, row_id)) AS lead_row, count(DISTINCT kind) AS kinds FROM i GROUP BY chat_id, session""")
def episode_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gap_sessions(event_messages(spark, sf_dir), 720)
    return rows.groupBy("chat_id", "session").agg(
        F.count("*").alias("n"), F.max("k").alias("top_score"), F.least(F.lit(100), F.max("k") + F.least(F.lit(40), 8 * F.count("*"))).alias("importance"), F.min_by("row_id", F.struct("us", "row_id")).alias("lead_row"), F.countDistinct("kind").alias("kinds"),
    )


@query(_session_sql(1440) + """, e AS (SELECT chat_id, session, count(*) AS n, count(*) FILTER (kind <> 'error') AS inbound, count(DISTINCT k) AS participants, arg_max(row_id, (value, -row_id)) AS lead FROM i GROUP BY chat_id, session)
SELECT *, least(100, 10 * n + 5 * participants) AS importance FROM e WHERE n >= 3 AND participants >= 2 ORDER BY least(100, 10 * n + 5 * participants) DESC, n DESC, chat_id, session LIMIT 24""")
def discussion_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense islands of talk; the best 24 by importance."""
    rows = gap_sessions(event_messages(spark, sf_dir), 1440).groupBy("chat_id", "session").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") != "error").alias("inbound"), F.countDistinct("k").alias("participants"), F.max_by("row_id", F.struct("value", -F.col("row_id"))).alias("lead"),
    )
    rows = rows.where("n >= 3 AND participants >= 2").withColumn("importance", F.least(F.lit(100), 10 * F.col("n") + 5 * F.col("participants")))
    return rows.orderBy(F.desc("importance"), F.desc("n"), "chat_id", "session").limit(24)


@query(f"""WITH {M}, g AS (SELECT chat_id, us - lag(us) OVER (PARTITION BY chat_id ORDER BY us, row_id) AS gap FROM m)
SELECT chat_id, count(gap) AS n_gaps, CASE WHEN count(gap) >= 3 THEN greatest(4 * quantile_cont(gap, 0.5), 2 * quantile_cont(gap, 0.75)) END AS cutoff_us FROM g GROUP BY chat_id""")
def adaptive_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_cutoffs(event_messages(spark, sf_dir))


@query("""WITH s AS (SELECT sha256(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS sig, doc_id, source, lang, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) >= 10 AS long FROM documents)
SELECT CASE WHEN long THEN sig ELSE 'doc ' || doc_id END AS sig, count(*) AS n, count(DISTINCT source) AS chats, min(doc_id) AS first_doc, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM s GROUP BY 1""")
def small_matter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matters of one signature are merged; signatures under ten letters are kept apart."""
    bare = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    sig = F.when(F.length(bare) >= 10, F.sha2(bare, 256)).otherwise(F.concat(F.lit("doc "), F.col("doc_id")))
    rows = table(spark, sf_dir, "documents").select(sig.alias("sig"), "doc_id", "source", "lang")
    return rows.groupBy("sig").agg(F.count("*").alias("n"), F.countDistinct("source").alias("chats"), F.min("doc_id").alias("first_doc"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


LAYERS = "CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'suppressed' WHEN quality = 0 THEN 'noise' WHEN score >= 60 THEN 'highlight' WHEN score >= 28 THEN 'discovery' WHEN n_chars < 200 THEN 'context' ELSE 'retained' END"


@query(f"WITH {SCORED} SELECT doc_id, {LAYERS} AS layer FROM s LEFT JOIN labels l USING (doc_id)")
def retention_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every input, in the first of seven layers that takes it."""
    rows = scored_documents(spark, sf_dir).select("doc_id", "score", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    layer = (
        F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "suppressed").when(F.col("quality") == 0, "noise").when(F.col("score") >= 60, "highlight")
        .when(F.col("score") >= 28, "discovery").when(F.col("n_chars") < 200, "context").otherwise("retained")
    )
    return rows.select("doc_id", layer.alias("layer"))


@query(f"WITH {SCORED}, r AS (SELECT {LAYERS} AS layer FROM s LEFT JOIN labels l USING (doc_id)) SELECT layer, count(*) AS n FROM r GROUP BY layer")
def retention_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention_ledger(spark, sf_dir).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT doc_id, score FROM s WHERE score >= 28 AND ((SELECT max(score) FROM s) < 60 OR score >= 60) ORDER BY score DESC, doc_id DESC LIMIT 12")
def highlights_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twelve: high ones if there are any, else medium ones."""
    s = scored_documents(spark, sf_dir).select("doc_id", "score").where("score >= 28")
    return s.orderBy(F.desc("score"), F.desc("doc_id")).limit(12).withColumn("top", F.max("score").over(W.partitionBy(F.lit(1)))).where("top < 60 OR score >= 60").drop("top")


QUOTA_N, QUOTA = 200, 20


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS own FROM s), f AS (SELECT *, row_number() OVER (ORDER BY own > {QUOTA}, score DESC, doc_id) AS place FROM r)
SELECT doc_id, source, score, 'm-' || lpad((row_number() OVER (ORDER BY doc_id))::VARCHAR, 3, '0') AS ref FROM f WHERE place <= {QUOTA_N}""")
def per_chat_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidates with a quota for each chat, filled up in rank order by those over it. Only a
    bounded number from each salted part of a chat can be chosen, so ranking has no hot task."""
    s = scored_documents(spark, sf_dir).select("doc_id", "source", "score")
    salt = W.partitionBy("source", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(F.desc("score"), "doc_id")
    s = s.withColumn("part", F.row_number().over(salt)).where(F.col("part") <= QUOTA_N)
    r = s.withColumn("own", F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "doc_id")))
    best = r.orderBy(F.col("own") > QUOTA, F.desc("score"), "doc_id").limit(QUOTA_N)
    ref = F.concat(F.lit("m-"), F.lpad(F.row_number().over(W.orderBy("doc_id")).cast("string"), 3, "0"))
    return best.select("doc_id", "source", "score", ref.alias("ref"))


@query(f"""WITH {M}, s AS (SELECT row_id, chat_id, us, last_value(CASE WHEN kind = 'purchase' THEN k END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM m) SELECT row_id, carried FROM s""")
def carried_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last subject known before each message of a chat."""
    order = W.partitionBy("chat_id").orderBy("us", "row_id")
    return event_messages(spark, sf_dir).select("row_id", carried(F.when(F.col("kind") == "purchase", F.col("k")), order).alias("carried"))


@query("""SELECT conv_id AS chat_id, turn AS pos, min(CASE WHEN role = 'assistant' AND length(text) >= 40 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answered_at FROM conversations QUALIFY role = 'user'""")
def answer_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next substantive answer to each request."""
    later = W.partitionBy("chat_id").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    at = F.min(F.when(F.col("is_self") & (F.length("content") >= 40), F.col("pos"))).over(later)
    return turn_messages(spark, sf_dir).withColumn("answered_at", at).where(F.col("role") == "user").select("chat_id", "pos", "answered_at")


@query(f"""WITH {M}, d AS (SELECT chat_id, us // {DAY} AS day, count(*) AS n FROM m GROUP BY ALL) SELECT day, sum(n)::BIGINT AS n, count(*) AS chats, max(n) AS largest_chat FROM d GROUP BY day""")
def nested_date_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_messages(spark, sf_dir).groupBy("chat_id", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"))
    return d.groupBy("day").agg(F.sum("n").alias("n"), F.count("*").alias("chats"), F.max("n").alias("largest_chat"))


@query("SELECT conv_id AS chat_id, count(*) AS n, min(turn) AS first_pos, max(turn) AS last_pos, count(DISTINCT role) AS participants, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def chat_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.countDistinct("role").alias("participants"), F.sum(F.length("content")).alias("chars"))


@query(f"WITH {M} SELECT chat_id, sum(coalesce(k, 0))::BIGINT AS tokens_in, sum(CASE WHEN kind = 'click' THEN coalesce(k, 0) ELSE 0 END)::BIGINT AS tokens_out, count(*) FILTER (k IS NULL) AS unreported FROM m GROUP BY chat_id")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce("k", F.lit(0))
    return event_messages(spark, sf_dir).groupBy("chat_id").agg(F.sum(k).alias("tokens_in"), F.sum(F.when(F.col("kind") == "click", k).otherwise(0)).alias("tokens_out"), F.count_if(F.col("k").isNull()).alias("unreported"))


@query("""WITH c AS (SELECT DISTINCT trim(c) AS clause FROM (SELECT unnest(string_split_regex(text, '[.!?\\n]+')) AS c FROM documents)) SELECT sha256(clause) AS clause_id, length(clause) AS chars FROM c WHERE length(clause) >= 12 AND regexp_matches(clause, '[0-9]{3,}') AND NOT regexp_matches(clause, '^https?://\\S+$')""")
def checkable_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that state something checkable (here: a number), each once."""
    c = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[.!?\\n]+")).alias("clause")).select(F.trim("clause").alias("clause"))
    c = c.where((F.length("clause") >= 12) & F.col("clause").rlike("[0-9]{3,}") & ~F.col("clause").rlike("^https?://\\S+$")).distinct()
    return c.select(F.sha2("clause", 256).alias("clause_id"), F.length("clause").cast("long").alias("chars"))


@query(f"""WITH {M} SELECT row_id, value::BIGINT * 3 + (chat_id % 7) * 2 + CASE WHEN kind = 'error' THEN -5 ELSE 0 END AS total, kind = 'error' AS penalised FROM m""")
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parts of a score as a map, and their sum."""
    whole = F.bround(F.col("value")).cast("long")
    parts = F.create_map(F.lit("value"), whole * 3, F.lit("chat"), (F.col("chat_id") % 7) * 2, F.lit("penalty"), F.when(F.col("kind") == "error", F.lit(-5).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = event_messages(spark, sf_dir).select("row_id", parts.alias("parts"))
    return rows.select("row_id", F.aggregate(F.map_values("parts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (F.col("parts")["penalty"] < 0).alias("penalised"))
