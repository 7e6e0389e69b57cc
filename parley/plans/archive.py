"""Archive reads, writes by key, and the workbench's lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.operators.graph import shared_folder
from parley.operators.upsert import enrich_upsert, latest_by_key, protected_latest, task_states
from parley.plans.registry import ORACLES, query
from parley.sources import manifest
from parley.sources.tables import between, event_messages, instant, table, turn_messages, union_shards

M = "m AS (SELECT event_id AS row_id, user_id AS chat_id, ts, epoch_us(ts) AS us, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC


@query(f"""WITH {M} SELECT chat_id, count(*) AS messages, count(*) FILTER (kind <> 'error') AS inbound, count(*) FILTER (value >= 50) AS high_signal,
  bool_or(kind = 'purchase') AS is_group, max(us) AS last_us, arg_max(kind, (us, row_id)) AS last_kind, arg_max(row_id, (us, row_id)) AS last_row FROM m GROUP BY chat_id""")
def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir)
    last = F.max_by(F.struct("kind", "row_id"), F.struct("us", "row_id"))
    out = m.groupBy("chat_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("kind") != "error").alias("inbound"), F.count_if(F.col("value") >= 50).alias("high_signal"),
        F.bool_or(F.col("kind") == "purchase").alias("is_group"), F.max("us").alias("last_us"), last.alias("last"),
    )
    return out.select("chat_id", "messages", "inbound", "high_signal", "is_group", "last_us", F.col("last.kind").alias("last_kind"), F.col("last.row_id").alias("last_row"))


@query(f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY us DESC, row_id DESC) AS n FROM m WHERE us >= {START + DAY} AND us < {START + 20 * DAY} AND row_id > 100)
SELECT kind AS shard, row_id, chat_id, us FROM r WHERE n <= 50""")
def sharded_chat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shard the newest 50 rows past a watermark in a half-open range; shards are appended."""
    m = between(event_messages(spark, sf_dir), START + DAY, START + 20 * DAY).where("row_id > 100")
    n = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("us"), F.desc("row_id")))
    return m.withColumn("n", n).where("n <= 50").select(F.col("kind").alias("shard"), "row_id", "chat_id", "us")


@query(f"WITH {M} SELECT row_id, chat_id, us, kind FROM m WHERE us >= {START + 2 * DAY} AND us < {START + 9 * DAY} ORDER BY us, row_id LIMIT 500")
def archive_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open range, a true first n by (time, row)."""
    m = between(event_messages(spark, sf_dir), START + 2 * DAY, START + 9 * DAY)
    return m.select("row_id", "chat_id", "us", "kind").orderBy("us", "row_id").limit(500)


@query(f"WITH {M} SELECT chat_id, max(row_id) AS watermark, max(us) AS last_us FROM m GROUP BY chat_id")
def chat_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages(spark, sf_dir).groupBy("chat_id").agg(F.max("row_id").alias("watermark"), F.max("us").alias("last_us"))


@query(f"""WITH {M}, c AS (SELECT chat_id, count(*) AS messages FROM m GROUP BY chat_id)
SELECT chat_id, coalesce(c_name, 'chat ' || chat_id) AS chat_name, messages FROM c LEFT JOIN customer ON c_custkey = chat_id
UNION ALL SELECT -1, 'default', 0 WHERE NOT EXISTS (SELECT 1 FROM c WHERE chat_id = -1)""")
def chat_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by chat with contact names, and a default row if there is none."""
    c = event_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("messages"))
    named = c.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("chat_id"), "left")
    named = named.select("chat_id", F.coalesce("c_name", F.concat(F.lit("chat "), F.col("chat_id"))).alias("chat_name"), "messages")
    default = spark.range(1).select(F.lit(-1).cast("long").alias("chat_id"), F.lit("default").alias("chat_name"), F.lit(0).cast("long").alias("messages"))
    return named.unionByName(default.join(c.where("chat_id = -1"), "chat_id", "left_anti"))


@query(f"WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us DESC, row_id DESC) AS n FROM m) SELECT chat_id, row_id, us, n AS newest FROM r WHERE n <= 5")
def latest_messages_per_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("us"), F.desc("row_id")))
    return event_messages(spark, sf_dir).withColumn("n", n.cast("long")).where("n <= 5").select("chat_id", "row_id", "us", F.col("n").alias("newest"))


@query(f"""WITH {M} SELECT chat_id || ':' || kind || ':' || row_id AS message_id, CASE WHEN k % 3 = 2 THEN true WHEN k % 3 = 1 THEN false END AS is_self,
 CASE kind WHEN 'view' THEN 'image' WHEN 'click' THEN 'text' WHEN 'purchase' THEN 'voice' WHEN 'error' THEN 'system' ELSE 'other' END AS message_type, us FROM m""")
def normalized_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to messages: composed id, three-valued direction, type map."""
    types = F.create_map(*map(F.lit, ("view", "image", "click", "text", "purchase", "voice", "error", "system")))
    side = F.when(F.col("k") % 3 == 2, True).when(F.col("k") % 3 == 1, False)
    return event_messages(spark, sf_dir).select(F.concat_ws(":", "chat_id", "kind", "row_id").alias("message_id"), side.alias("is_self"), F.coalesce(F.try_element_at(types, F.col("kind")), F.lit("other")).alias("message_type"), "us")


@query("""WITH g AS (SELECT conv_id, turn, role || ':' || chr(10) || ' ' || text AS content FROM conversations)
SELECT conv_id AS chat_id, turn AS pos, regexp_extract(content, '^([A-Za-z0-9_-]{1,64}):\\s*\\n', 1) AS sender, sha256(trim(regexp_replace(content, '^[A-Za-z0-9_-]{1,64}:\\s*\\n\\s*', ''))) AS body_sha FROM g""")
def group_prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sender:`` and a line break lead group texts: split into sender and body."""
    content = F.concat("role", F.lit(":\n "), "content")
    body = F.trim(F.regexp_replace(content, "^[A-Za-z0-9_-]{1,64}:\\s*\\n\\s*", ""))
    return turn_messages(spark, sf_dir).select("chat_id", "pos", F.regexp_extract(content, "^([A-Za-z0-9_-]{1,64}):\\s*\\n", 1).alias("sender"), F.sha2(body, 256).alias("body_sha"))


@query("""SELECT c_custkey AS sender_id, CASE WHEN c_acctbal > 5000 THEN c_name WHEN n_name IS NOT NULL AND c_custkey % 2 = 0 THEN n_name WHEN c_mktsegment <> '' THEN c_mktsegment ELSE 'unknown' END AS sender_name,
CASE WHEN c_acctbal > 5000 THEN 'contact_remark' WHEN n_name IS NOT NULL AND c_custkey % 2 = 0 THEN 'contact_nickname' WHEN c_mktsegment <> '' THEN 'group_nickname' ELSE 'observed' END AS source,
CASE WHEN c_acctbal > 5000 THEN 1.0::DOUBLE WHEN n_name IS NOT NULL AND c_custkey % 2 = 0 THEN 0.9::DOUBLE WHEN c_mktsegment <> '' THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS confidence
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered choice among name sources, with the source's label and confidence."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    option = lambda ok, name, source, trust: F.when(ok, F.struct(name.alias("n"), F.lit(source).alias("s"), F.lit(trust).alias("c")))
    pick = F.coalesce(
        option(F.col("c_acctbal") > 5000, F.col("c_name"), "contact_remark", 1.0),
        option(F.col("n_name").isNotNull() & (F.col("c_custkey") % 2 == 0), F.col("n_name"), "contact_nickname", 0.9),
        option(F.col("c_mktsegment") != "", F.col("c_mktsegment"), "group_nickname", 0.8),
        option(F.lit(True), F.lit("unknown"), "observed", 0.3),
    )
    return rows.select(F.col("c_custkey").alias("sender_id"), pick.alias("p")).select("sender_id", F.col("p.n").alias("sender_name"), F.col("p.s").alias("source"), F.col("p.c").alias("confidence"))


@query(f"WITH {M}, r AS (SELECT us // {DAY} AS day, row_id, row_number() OVER (PARTITION BY us // {DAY} ORDER BY row_id) AS n FROM m) SELECT day, row_id, n FROM r WHERE n > 3 AND n <= 8")
def dated_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 4 to 8 of each day: an offset and a limit within the day."""
    m = event_messages(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    n = F.row_number().over(W.partitionBy("day").orderBy("row_id")).cast("long")
    return m.withColumn("n", n).where("n > 3 AND n <= 8").select("day", "row_id", "n")


@query(f"""WITH {M}, p AS (SELECT chat_id, row_id, us, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m), s AS (SELECT * FROM p WHERE row_id % 50 = 0)
SELECT s.row_id AS sample_id, p.row_id, p.pos - s.pos AS distance FROM s JOIN p ON p.chat_id = s.chat_id AND p.pos BETWEEN s.pos - 2 AND s.pos + 2""")
def sample_context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours up to two places away in the chat of each sampled row, by an equi-join on place."""
    p = event_messages(spark, sf_dir).select("chat_id", "row_id", F.row_number().over(W.partitionBy("chat_id").orderBy("us", "row_id")).alias("pos"))
    s = p.where("row_id % 50 = 0").select("chat_id", F.col("row_id").alias("sample_id"), F.col("pos").alias("at"), F.explode(F.sequence(F.col("pos") - 2, F.col("pos") + 2)).alias("pos"))
    return s.join(p, ["chat_id", "pos"]).select("sample_id", "row_id", (F.col("pos") - F.col("at")).cast("long").alias("distance"))


@query("""SELECT event_id AS row_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS is_json, json_extract_string(props, '$.missing') IS NULL AS lacks_field FROM events""")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declared object in each payload; what is malformed is marked, not dropped."""
    parsed = F.from_json("props", "k int, missing string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = table(spark, sf_dir, "events").select("event_id", parsed.alias("p"))
    return rows.select(F.col("event_id").alias("row_id"), F.col("p.k").alias("k"), F.col("p._bad").isNull().alias("is_json"), F.col("p.missing").isNull().alias("lacks_field"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS tag FROM pages)
SELECT page_id, regexp_extract(tag, 'href="([^"]*)"', 1) AS url, regexp_extract(tag, '>([^<]*)</a>', 1) AS title, count(*) AS n FROM a GROUP BY ALL""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as (url, title) rows."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0))).alias("tag"))
    rows = tags.select("page_id", F.regexp_extract("tag", 'href="([^"]*)"', 1).alias("url"), F.regexp_extract("tag", ">([^<]*)</a>", 1).alias("title"))
    return rows.groupBy("page_id", "url", "title").agg(F.count("*").alias("n"))


@query(f"""WITH {M} SELECT row_id, CASE kind WHEN 'view' THEN '[image ' || k || ']' WHEN 'purchase' THEN '[voice ' || k || 's]' WHEN 'error' THEN '* error ' || k WHEN 'signup' THEN '> quote ' || k ELSE 'user ' || chat_id || ': ' || kind END AS line FROM m""")
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed payloads as export lines."""
    kind, k = F.col("kind"), F.col("k").cast("string")
    line = (
        F.when(kind == "view", F.concat(F.lit("[image "), k, F.lit("]"))).when(kind == "purchase", F.concat(F.lit("[voice "), k, F.lit("s]")))
        .when(kind == "error", F.concat(F.lit("* error "), k)).when(kind == "signup", F.concat(F.lit("> quote "), k)).otherwise(F.concat(F.lit("user "), F.col("chat_id"), F.lit(": "), kind))
    )
    return event_messages(spark, sf_dir).select("row_id", line.alias("line"))


@query("""WITH a AS (SELECT o_custkey AS key, o_orderkey AS arrival, nullif(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END, '') AS content, CASE WHEN o_orderkey % 5 > 0 THEN 'n' || (o_orderkey % 7) END AS name,
  CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 11) / 10.0::DOUBLE END AS conf, o_orderstatus = 'F' AS is_group, o_totalprice AS first_value FROM orders)
SELECT key, count(*) AS versions, arg_max(content, arrival) FILTER (content IS NOT NULL) AS content, arg_max(name, (conf, arrival)) FILTER (name IS NOT NULL) AS sender_name, max(conf) FILTER (name IS NOT NULL) AS confidence, bool_or(is_group) AS is_group, arg_min(first_value, arrival) AS first_value FROM a GROUP BY key""")
def ingest_enrich_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent ingest: the first row of a key stays and later ones enrich it."""
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), k.alias("arrival"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("content"),
        F.when(k % 5 > 0, F.concat(F.lit("n"), k % 7)).alias("name"), F.when(k % 5 > 0, (k % 11) / F.lit(10.0)).alias("conf"), (F.col("o_orderstatus") == "F").alias("is_group"), F.col("o_totalprice").alias("first_value"),
    )
    return enrich_upsert(a, ["key"], "arrival", fill=["content"], identity=("name", "conf"), sticky=["is_group"], first=["first_value"]).withColumnsRenamed({"name": "sender_name", "conf": "confidence"})


TASKS = f"""WITH {M}, e AS (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS part FROM m),
t AS (SELECT *, max(part) OVER (PARTITION BY chat_id) AS last_part FROM e)
SELECT chat_id AS task_id, count(*) FILTER (part = last_part AND kind IN ('click', 'error')) AS attempts,
 CASE WHEN count(*) FILTER (part = last_part AND kind = 'purchase') > 0 THEN 'succeeded' WHEN count(*) FILTER (part = last_part AND kind = 'error') >= 3 THEN 'failed' ELSE 'pending' END AS status, count(*) FILTER (kind = 'signup') AS retries FROM t GROUP BY chat_id"""


@query(TASKS)
def task_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each task from its log of tries: a retry starts anew, a success ends it, and three
    failures since the last retry fail it."""
    m = event_messages(spark, sf_dir)
    return task_states(m, key="chat_id", retry="signup", success="purchase", failure="error", claim="click", max_attempts=3)


@query("SELECT o_custkey AS event_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS action, max(o_orderdate)::DATE AS updated FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_custkey")
def feedback_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O", "P"))
    out = latest_by_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select(F.col("o_custkey").alias("event_id"), F.col("o_orderstatus").alias("action"), F.col("o_orderdate").cast("date").alias("updated"))


@query("""SELECT o_custkey AS message_id, arg_max(o_orderkey, (o_orderstatus = 'F', o_orderdate, o_orderkey)) AS row_id, bool_or(o_orderstatus = 'F') AS corrected FROM orders GROUP BY o_custkey""")
def transcript_protected_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected transcripts outrank later automatic ones."""
    o = table(spark, sf_dir, "orders").withColumn("corrected", F.col("o_orderstatus") == "F")
    return protected_latest(o, ["o_custkey"], "corrected", ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("message_id"), F.col("o_orderkey").alias("row_id"), "corrected")


@query("""WITH r AS (SELECT l_suppkey AS job_id, l_orderkey AS seq, l_linenumber AS line, l_quantity::BIGINT AS seen, l_linestatus AS status FROM lineitem)
SELECT job_id, arg_max(status, (seq, line)) AS status, sum(seen)::BIGINT AS seen, count(*) AS updates, count(*) FILTER (seen < 0) AS invalid FROM r GROUP BY job_id""")
def sync_run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates of runs: newest status, summed counts, counts under zero marked."""
    r = table(spark, sf_dir, "lineitem")
    seen = F.col("l_quantity").cast("long")
    return r.groupBy(F.col("l_suppkey").alias("job_id")).agg(F.max_by("l_linestatus", F.struct("l_orderkey", "l_linenumber")).alias("status"), F.sum(seen).alias("seen"), F.count("*").alias("updates"), F.count_if(seen < 0).alias("invalid"))


@query(f"""WITH {M}, d AS (SELECT *, row_number() OVER (PARTITION BY chat_id, k ORDER BY us, row_id) AS again FROM m), n AS (SELECT *, sum(CASE WHEN again = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS used FROM d)
SELECT row_id, CASE WHEN again > 1 THEN 'duplicate' WHEN used > 20 THEN 'over_limit' ELSE 'reserved' END AS outcome FROM n""")
def call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations by budget: duplicates and those over the limit are refused and logged."""
    order = W.partitionBy("chat_id").orderBy("us", "row_id")
    rows = event_messages(spark, sf_dir).withColumn("again", F.row_number().over(W.partitionBy("chat_id", "k").orderBy("us", "row_id")))
    used = F.sum((F.col("again") == 1).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).select("row_id", F.when(F.col("again") > 1, "duplicate").when(F.col("used") > 20, "over_limit").otherwise("reserved").alias("outcome"))


@query("SELECT source, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars, bit_xor(('0x' || substr(sha256(coalesce(text, '')), 1, 15))::BIGINT) AS content_hash FROM documents GROUP BY source")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and content hash of each part of an export, whatever the order of its rows; the hash
    combines before the shuffle, so a part may hold any share of the rows."""
    h = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"), F.bit_xor(h).alias("content_hash"))


@query(ORACLES["export_manifest"])
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """export_manifest of what was written as JSON lines with a manifest, checked, and read back."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    manifest.write(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars"), path)
    back = manifest.read(spark, path, "doc_id long, source string, text string, n_chars long")
    h = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10).cast("long")
    return back.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"), F.bit_xor(h).alias("content_hash"))


@query("""SELECT l_orderkey AS task_id, l_linenumber AS attempt, o_orderstatus AS status, o_custkey AS message_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'""")
def tasks_with_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("attempt"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("message_id"))


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AS has_transcript, CASE WHEN l.doc_id IS NULL THEN 'none' WHEN quality = 1 THEN 'transcribed' ELSE 'rejected' END AS voice_status, coalesce(quality, 0) = 1 AS text_candidate FROM documents d LEFT JOIN labels l USING (doc_id)""")
def transcript_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    known = F.col("quality").isNotNull()
    return d.select("doc_id", known.alias("has_transcript"), F.when(~known, "none").when(F.col("quality") == 1, "transcribed").otherwise("rejected").alias("voice_status"), (F.coalesce("quality", F.lit(0)) == 1).alias("text_candidate"))


@query("""WITH f AS (SELECT o_custkey, o_orderstatus, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY ALL)
SELECT o.o_orderkey AS event_id, f.latest, f.latest = o.o_orderkey AS is_latest FROM orders o LEFT JOIN f ON f.o_custkey = o.o_custkey AND f.o_orderstatus = o.o_orderstatus""")
def composite_key_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest check of each composite key beside every event."""
    o = table(spark, sf_dir, "orders")
    latest = F.max("o").over(W.partitionBy("o_custkey", "o_orderstatus"))
    rows = o.withColumn("o", F.struct("o_orderdate", "o_orderkey")).withColumn("latest", latest["o_orderkey"])
    return rows.select(F.col("o_orderkey").alias("event_id"), "latest", (F.col("latest") == F.col("o_orderkey")).alias("is_latest"))


@query(f"""WITH {M} SELECT row_id, chat_id, us, kind FROM m WHERE (us, row_id) < ({START + 10 * DAY}, 0) ORDER BY us DESC, row_id DESC LIMIT 51""")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyset page: strictly before the cursor, one row more than the page to tell if there is more."""
    m = event_messages(spark, sf_dir)
    before = F.struct("us", "row_id") < F.struct(F.lit(START + 10 * DAY), F.lit(0).cast("long"))
    m = m.where(F.col("ts") <= instant(START + 10 * DAY))  # implied, and known to the scan
    return m.where(before).orderBy(F.desc("us"), F.desc("row_id")).limit(51).select("row_id", "chat_id", "us", "kind")


@query(f"""WITH {M} SELECT row_id, 'v1.' || replace(replace(rtrim(to_base64(CAST('[' || us || ',' || row_id || ']' AS BLOB)), '='), '+', '-'), '/', '_') AS cursor FROM m""")
def feed_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("["), F.col("us"), F.lit(","), F.col("row_id"), F.lit("]"))
    return event_messages(spark, sf_dir).select("row_id", F.concat(F.lit("v1."), F.translate(F.rtrim(F.base64(raw.cast("binary")), F.lit("=")), "+/", "-_")).alias("cursor"))


@query(f"""WITH {M}, s AS (SELECT * FROM m WHERE kind = 'view'), t AS (SELECT * FROM m WHERE kind <> 'view')
SELECT kind AS shard, count(*) AS n, count(k) AS n_k FROM (SELECT row_id, kind, NULL::INTEGER AS k FROM s UNION ALL SELECT row_id, kind, k FROM t) GROUP BY kind""")
def union_of_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with different columns, appended; what one lacks is null."""
    m = event_messages(spark, sf_dir)
    rows = union_shards([m.where("kind = 'view'").select("row_id", "kind"), m.where("kind <> 'view'").select("row_id", "kind", "k")])
    return rows.groupBy(F.col("kind").alias("shard")).agg(F.count("*").alias("n"), F.count("k").alias("n_k"))


@query("SELECT sha256(text) AS key, min(doc_id) AS doc_id, count(*) AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY sha256(text)")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS extra,
 (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS duplicated""")
def set_difference_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one side lacks, what it has beyond, what it has twice: one full outer join of counts."""
    a = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("a"))
    b = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("b"))
    return a.join(b, "doc_id", "full").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.coalesce(F.sum(F.col("b") - 1), F.lit(0)).alias("duplicated"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS large, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.countDistinct("o_custkey").alias("customers"))


def _three_valued(name: str) -> Column:
    return F.count_if(F.col(name).isNull())


@query("""SELECT count(*) AS messages, count(DISTINCT conv_id) AS chats, count(*) FILTER (role = 'user') AS inbound, count(*) FILTER (role = 'assistant') AS outbound, count(*) FILTER (role NOT IN ('user', 'assistant')) AS unknown, greatest(0, 1000 - count(*)) AS shortfall FROM conversations""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = turn_messages(spark, sf_dir)
    return m.agg(
        F.count("*").alias("messages"), F.countDistinct("chat_id").alias("chats"), F.count_if(F.col("is_self") == F.lit(False)).alias("inbound"), F.count_if("is_self").alias("outbound"), _three_valued("is_self").alias("unknown"),
        F.greatest(F.lit(0).cast("long"), F.lit(1000) - F.count("*")).alias("shortfall"),
    )
