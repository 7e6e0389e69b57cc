"""Pages of several streams, and packets with the pairs that lie in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.functions import text as T
from parley.operators.pairs import placed
from parley.operators.paging import stream_pages as pages_of
from parley.plans.archive import M
from parley.plans.registry import query
from parley.sources.tables import event_messages, turn_messages

CAPS, BUDGET = (3, 2, 2), 180
PACKET = 4


@query(f"""WITH RECURSIVE t AS (SELECT conv_id AS root, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS stream, turn, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens FROM conversations),
a AS (SELECT root, {", ".join(f"coalesce(list(tokens ORDER BY turn) FILTER (stream = {k}), []) AS s{k}" for k in range(3))} FROM t GROUP BY root),
b AS (SELECT *, {", ".join(f"list_transform(range(0, len(s{k}) + 1), lambda i: coalesce(list_sum(s{k}[1:i]), 0))::BIGINT[] AS p{k}" for k in range(3))} FROM a),
r AS (SELECT root, -1::BIGINT AS page, 0::BIGINT AS c0, 0::BIGINT AS c1, 0::BIGINT AS c2, 0::BIGINT AS n0, 0::BIGINT AS n1, 0::BIGINT AS n2, 0::BIGINT AS tokens, '' AS status FROM b
UNION ALL SELECT root, page + 1, c0 + m0, c1 + m1, c2 + m2, m0, m1, m2, u2 + CASE WHEN f2 THEN p2[c2 + 2] - p2[c2 + 1] ELSE 0 END, CASE WHEN f0 OR f1 OR f2 THEN 'pending' ELSE 'ready' END FROM (
 SELECT *, m0 + m1 = 0 AND NOT (f0 OR f1) AND k2 = 0 AND c2 < len(s2) AS f2, CASE WHEN m0 + m1 = 0 AND NOT (f0 OR f1) AND k2 = 0 AND c2 < len(s2) THEN 1 ELSE k2 END AS m2, u1 + p2[c2 + k2 + 1] - p2[c2 + 1] AS u2 FROM (
 SELECT *, CASE WHEN f0 OR f1 THEN 0 ELSE len(list_filter(range(1, {CAPS[2]} + 1), lambda k: c2 + k <= len(s2) AND u1 + p2[c2 + k + 1] - p2[c2 + 1] <= {BUDGET})) END AS k2 FROM (
 SELECT *, m0 = 0 AND NOT f0 AND k1 = 0 AND c1 < len(s1) AS f1, CASE WHEN m0 = 0 AND NOT f0 AND k1 = 0 AND c1 < len(s1) THEN 1 ELSE k1 END AS m1,
   u0 + p1[c1 + CASE WHEN m0 = 0 AND NOT f0 AND k1 = 0 AND c1 < len(s1) THEN 1 ELSE k1 END + 1] - p1[c1 + 1] AS u1 FROM (
 SELECT *, CASE WHEN f0 THEN 0 ELSE len(list_filter(range(1, {CAPS[1]} + 1), lambda k: c1 + k <= len(s1) AND u0 + p1[c1 + k + 1] - p1[c1 + 1] <= {BUDGET})) END AS k1 FROM (
 SELECT *, k0 = 0 AND c0 < len(s0) AS f0, CASE WHEN k0 = 0 AND c0 < len(s0) THEN 1 ELSE k0 END AS m0, p0[c0 + CASE WHEN k0 = 0 AND c0 < len(s0) THEN 1 ELSE k0 END + 1] - p0[c0 + 1] AS u0 FROM (
 SELECT r.root, r.page, r.c0, r.c1, r.c2, b.*  EXCLUDE (root), len(list_filter(range(1, {CAPS[0]} + 1), lambda k: r.c0 + k <= len(b.s0) AND b.p0[r.c0 + k + 1] - b.p0[r.c0 + 1] <= {BUDGET})) AS k0
 FROM r JOIN b ON b.root = r.root WHERE r.c0 < len(b.s0) OR r.c1 < len(b.s1) OR r.c2 < len(b.s2))))))))
SELECT root, page, n0, n1, n2, tokens, status FROM r WHERE page >= 0""")
def three_stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users, assistants and others into pages under a cap each and one token budget; what fits nowhere waits."""
    stream = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    rows = turn_messages(spark, sf_dir).select(F.col("chat_id").alias("root"), stream.alias("stream"), "pos", T.token_estimate(F.col("content")).alias("tokens"))
    return pages_of(rows, CAPS, BUDGET)


@query(f"""WITH {M}, p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) - 1 AS pos FROM m),
s AS (SELECT chat_id, pos // {PACKET} AS packet, row_id, true AS focus FROM p UNION ALL SELECT chat_id, pos // {PACKET} - 1, row_id, false FROM p WHERE pos % {PACKET} = 0
  UNION ALL SELECT chat_id, pos // {PACKET} + 1, row_id, false FROM p WHERE pos % {PACKET} = {PACKET - 1}),
c AS (SELECT chat_id, packet, count(*) FILTER (focus) AS focus, count(*) FILTER (NOT focus) AS context_only, min(row_id) FILTER (focus) AS first_member FROM s GROUP BY ALL HAVING count(*) FILTER (focus) > 0),
x AS (SELECT a.chat_id, a.pos // {PACKET} AS packet, a.row_id AS a, b.row_id AS b, b.pos - a.pos AS d FROM p a JOIN p b ON a.chat_id = b.chat_id AND b.pos > a.pos AND b.pos <= a.pos + 2 AND a.k % 5 = b.k % 5 WHERE a.pos // {PACKET} = b.pos // {PACKET}),
y AS (SELECT chat_id, packet, count(*) AS pairs, count(*) FILTER (d = 1) AS adjacent, count(*) FILTER (d = 2) AS skipping, string_agg(a || '-' || b, ',' ORDER BY a, b) AS pair_ids FROM x GROUP BY ALL)
SELECT c.chat_id, c.packet, focus, context_only, first_member, coalesce(pairs, 0) AS pairs, coalesce(adjacent, 0) AS adjacent, coalesce(skipping, 0) AS skipping, coalesce(pair_ids, '') AS pair_ids FROM c LEFT JOIN y USING (chat_id, packet)""")
def packet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of four messages with a neighbour on each side as context, and the candidate pairs whose ends both are
    in a packet and neither is context, by view. Places tell the packet of both ends, so pairs and packets
    meet in one grouping, not in a join."""
    p = placed(event_messages(spark, sf_dir)).select("chat_id", "row_id", (F.col("pos") - 1).cast("long").alias("pos"), (F.col("k") % 5).alias("topic"))
    order = W.partitionBy("chat_id").orderBy("pos")
    packet = F.floor(F.col("pos") / PACKET)
    ahead = [F.struct(F.lead("row_id", d).over(order).alias("b"), F.lead("topic", d).over(order).alias("topic"), F.lit(d).alias("d"), F.floor((F.col("pos") + d) / PACKET).alias("packet")) for d in (1, 2)]
    rows = p.withColumn("packet", packet).withColumn("ahead", F.array(*ahead))
    inside = F.filter("ahead", lambda x: x["b"].isNotNull() & (x["topic"] == F.col("topic")) & (x["packet"] == F.col("packet")))
    pairs = F.transform(inside, lambda x: F.struct(F.col("row_id").alias("a"), x["b"].alias("b"), x["d"].alias("d")))
    rows = rows.select("chat_id", "row_id", "pos", "packet", pairs.alias("pairs"))
    nothing = F.array().cast("array<struct<a:bigint,b:bigint,d:int>>")
    role = lambda at, focus: F.struct(at.alias("packet"), F.lit(focus).alias("focus"))
    edge = F.when(F.col("pos") % PACKET == 0, F.array(role(F.col("packet") - 1, False))).when(F.col("pos") % PACKET == PACKET - 1, F.array(role(F.col("packet") + 1, False)))
    seats = F.concat(F.array(role(F.col("packet"), True)), F.coalesce(edge, F.array().cast("array<struct<packet:bigint,focus:boolean>>")))
    members = rows.select("chat_id", "row_id", F.explode(seats).alias("seat"), "pairs").select("chat_id", "seat.packet", "seat.focus", "row_id", F.when(F.col("seat.focus"), F.col("pairs")).otherwise(nothing).alias("pairs"))
    found = members.groupBy("chat_id", "packet").agg(
        F.count_if("focus").alias("focus"), F.count_if(~F.col("focus")).alias("context_only"), F.min(F.when(F.col("focus"), F.col("row_id"))).alias("first_member"), F.array_sort(F.flatten(F.collect_list("pairs"))).alias("x"),
    ).where("focus > 0")
    count = lambda test: F.size(F.filter("x", test)).cast("long")
    ids = F.array_join(F.transform("x", lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))), ",")
    return found.select("chat_id", "packet", "focus", "context_only", "first_member", F.size("x").cast("long").alias("pairs"), count(lambda x: x["d"] == 1).alias("adjacent"), count(lambda x: x["d"] == 2).alias("skipping"), ids.alias("pair_ids"))
