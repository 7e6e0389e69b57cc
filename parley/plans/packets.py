"""Pages, envelopes, run catalogues and the last steps of model-assisted findings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.functions import text as T
from parley.operators import greedy
from parley.operators.pairs import neighbours, placed
from parley.plans.analytics import SCORED, scored_documents
from parley.plans.archive import M
from parley.plans.registry import ORACLES, query
from parley.sources.tables import event_messages, table

QUOTA_SQL = f"WITH q AS ({ORACLES['per_chat_quota']})"

#: Rows of the draw that come to the driver at a time.
BLOCK = 500


@query("""SELECT source AS page, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (contains(text, '@')) AS mail FROM documents GROUP BY source""")
def canonical_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-label facts of pages, one column a stratum, in one aggregate."""
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("page"))
    return d.agg(*[F.count_if(F.col("lang") == x).alias(x) for x in ("de", "en", "es", "fr")], F.count_if(F.col("text").contains("@")).alias("mail"))


@query(f"""WITH {M}, p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m),
x AS (SELECT a.row_id AS core, b.row_id AS member, concat_ws(',', CASE WHEN a.kind = b.kind THEN 'kind' END, CASE WHEN a.k % 10 = b.k % 10 THEN 'topic' END, CASE WHEN abs(a.pos - b.pos) = 1 THEN 'adjacent' END) AS reasons FROM p a JOIN p b ON a.chat_id = b.chat_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 3 WHERE a.kind = 'purchase')
SELECT core, member, reasons FROM x WHERE reasons <> ''""")
def review_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core rows with the neighbours that have a reason to be read with them."""
    x = neighbours(placed(event_messages(spark, sf_dir)).select("chat_id", "row_id", "kind", "k", "pos"), 3)
    reasons = F.concat_ws(",", F.when(F.col("a_kind") == F.col("b_kind"), "kind"), F.when(F.col("a_k") % 10 == F.col("b_k") % 10, "topic"), F.when(F.col("b_pos") - F.col("a_pos") == 1, "adjacent"))
    side = lambda c, m: F.when(F.col(f"{c}_kind") == "purchase", F.struct(F.col(f"{c}_row_id").alias("core"), F.col(f"{m}_row_id").alias("member")))
    return x.select(reasons.alias("reasons"), F.explode(F.array_compact(F.array(side("a", "b"), side("b", "a")))).alias("s")).where("reasons <> ''").select("s.core", "s.member", "reasons")


@query("""SELECT l_suppkey AS run, max(l_orderkey) AS version, arg_max(l_linestatus, (l_orderkey, l_linenumber)) AS status, count(DISTINCT l_orderkey) AS versions FROM lineitem GROUP BY l_suppkey""")
def run_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of every run."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.max("l_orderkey").alias("version"), F.max_by("l_linestatus", F.struct("l_orderkey", "l_linenumber")).alias("status"), F.countDistinct("l_orderkey").alias("versions"))


@query(f"""WITH {SCORED}, a AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0), f AS (SELECT s.doc_id, s.source, s.score FROM s JOIN a USING (doc_id) WHERE score >= 28), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM f) SELECT source, doc_id, place FROM r WHERE place <= 5""")
def verified_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings ranked by scope: only allowed ids pass, and only their order may change. Salted parts
    send on no more than can be ranked."""
    allowed = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    f = scored_documents(spark, sf_dir).where("score >= 28").select("doc_id", "source", "score").join(allowed, "doc_id")
    order = [F.desc("score"), F.col("doc_id")]
    part = F.row_number().over(W.partitionBy("source", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order))
    f = f.withColumn("p", part).where("p <= 5")
    return f.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(*order)).cast("long")).where("place <= 5").select("source", "doc_id", "place")


def _chosen(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "doc_id long, place int")


@query(f"""WITH RECURSIVE {SCORED}, c AS (SELECT doc_id AS id, coalesce(source, '') AS scope, list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS terms,
  row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS round FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY round, scope) AS k FROM c),
r(k, chosen) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, terms VARCHAR[])[]
  UNION ALL SELECT o.k, CASE WHEN len(list_filter(r.chosen, lambda x: len(list_intersect(x.terms, o.terms)) > 0.35 * len(list_distinct(x.terms || o.terms)))) > 0 THEN r.chosen
    ELSE list_append(r.chosen, {{'id': o.id, 'terms': o.terms}}) END FROM r JOIN o ON o.k = r.k + 1 WHERE len(r.chosen) < 20),
z AS (SELECT list_transform(arg_max(chosen, k), lambda x: x.id) AS ids FROM r)
SELECT unnest(ids) AS doc_id, (generate_subscripts(ids, 1) - 1)::INT AS place FROM z""")
def guarded_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents drawn from the scopes in turn, none alike to another by over .35."""
    s = scored_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", (-F.col("score")).alias("s"), T.terms(F.col("text"), 6).alias("terms"))
    return _chosen(spark, greedy.guarded_draw(s, "source", ["s", "id"], 20, 0.35, BLOCK))


@query(f"""WITH RECURSIVE {SCORED}, p AS (SELECT doc_id AS id, score, source AS scope, text, list_filter([lang, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '[0-9]{{6,}}') THEN 'number' END,
  CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS labels FROM s),
b AS (SELECT * FROM p WHERE id IN (SELECT min(id) FROM p GROUP BY text)),
r(step, chosen, covered, scopes) AS (SELECT 0, []::BIGINT[], []::VARCHAR[], []::VARCHAR[]
  UNION ALL SELECT step + 1, list_append(chosen, best.id), covered || best.labels, list_append(scopes, best.scope) FROM (
    SELECT r.*, (SELECT arg_max({{'id': id, 'labels': labels, 'scope': scope}}, (score + 20 * len(list_filter(labels, lambda x: NOT list_contains(r.covered, x))) - 15 * len(list_filter(r.scopes, lambda x: x = b.scope)), -id))
      FROM b WHERE NOT list_contains(r.chosen, b.id)) AS best FROM r WHERE step < 10) WHERE best IS NOT NULL),
z AS (SELECT unnest(chosen) AS id, generate_subscripts(chosen, 1) - 1 AS place FROM r WHERE step = (SELECT max(step) FROM r))
SELECT p.id AS doc_id, z.place, CASE WHEN z.place IS NOT NULL THEN 'selected' WHEN b.id IS NOT NULL THEN 'budget' ELSE 'duplicate' END AS decision FROM p LEFT JOIN z USING (id) LEFT JOIN b USING (id)""")
def budgeted_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten packages by score, coverage and diversity among those of distinct keys, and a decision on
    every candidate: selected (with its place), budget, or duplicate of another's key."""
    labels = F.array_compact(F.array(F.col("lang"), F.when(F.col("text").contains("@"), F.lit("mail")), F.when(F.col("text").rlike("[0-9]{6,}"), F.lit("number")), F.when(F.col("text").contains("|"), F.lit("table"))))
    s = scored_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "score", labels.alias("labels"), F.col("source").alias("scope"), F.xxhash64("text").alias("key"))
    best = s.groupBy("key").agg(F.min_by(F.struct("id", "score", "labels", "scope"), "id").alias("b")).select("b.*")
    chosen = _chosen(spark, greedy.budgeted(greedy.best_of_kind(best, 10).toPandas(), 10))
    rows = s.select(F.col("id").alias("doc_id")).join(best.select(F.col("id").alias("doc_id"), F.lit(True).alias("first")), "doc_id", "left").join(F.broadcast(chosen), "doc_id", "left")
    return rows.select("doc_id", "place", F.when(F.col("place").isNotNull(), "selected").when(F.col("first"), "budget").otherwise("duplicate").alias("decision"))


@query(QUOTA_SQL + """, a AS (SELECT doc_id, score::BIGINT AS score, len(list_distinct(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')))::BIGINT AS answer FROM q JOIN (SELECT doc_id, text FROM documents) USING (doc_id)),
g AS (SELECT doc_id, CASE WHEN answer >= 30 THEN answer ELSE score END AS rank_score, answer >= 30 AS supported FROM a) SELECT *, row_number() OVER (ORDER BY rank_score DESC, doc_id) AS place FROM g""")
def assisted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole assisted analysis with an injected model: quota of candidates, model output bound to
    their ids, gate, merge by signature, rank; what fails the gate falls back to the rule score."""
    from parley.operators.model import apply_model
    from parley.plans.analytics import per_chat_quota

    chosen = per_chat_quota(spark, sf_dir)
    texts = chosen.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    answers = apply_model(texts.select(F.col("doc_id").alias("chat_id"), F.col("score").cast("long").alias("pos"), F.col("text").alias("content")), lambda batch: [len(set(t.split())) for t in batch])
    gated = answers.select(F.col("chat_id").alias("doc_id"), F.when(F.col("answer") >= 30, F.col("answer")).otherwise(F.col("pos")).alias("rank_score"), (F.col("answer") >= 30).alias("supported"))
    return gated.withColumn("place", F.row_number().over(W.orderBy(F.desc("rank_score"), "doc_id")))


def _topics(bodies: list[str]) -> list[str]:
    """A stand-in model: topics by length; long packets are answered in prose, which is no answer."""
    packets = [json.loads(b) for b in bodies]
    return ["too long" if len(p) > 5 else json.dumps({m["handle"]: f"t{len(m['content']) % 2}" for m in p}) for p in packets]


def _claims(bodies: list[str]) -> list[str]:
    return [json.dumps([m["handle"] for m in json.loads(b) if len(m["content"]) >= 40]) for b in bodies]


def _audit(bodies: list[str]) -> list[str]:
    return [json.dumps({"ok": len(json.loads(b)) > 1}) for b in bodies]


@query("""WITH f AS (SELECT conv_id AS packet, 'm' || turn AS handle, coalesce(text, '') AS content FROM conversations),
a AS (SELECT packet, string_agg(handle || chr(1) || content, chr(2) ORDER BY handle, content) AS body, count(*) <= 5 AS ok FROM f GROUP BY packet),
b AS (SELECT packet, 't' || (length(content) % 2) AS topic, string_agg(handle || chr(1) || content, chr(2) ORDER BY handle, content) AS body, bool_or(length(content) >= 40) AS ok,
 'c' || string_agg(handle, ',' ORDER BY handle, content) FILTER (length(content) >= 40) AS claims FROM f JOIN a USING (packet) WHERE a.ok GROUP BY ALL),
c AS (SELECT packet, bool_and(ok) AS ready, count(*) > 1 AS ok, string_agg(topic || claims, chr(2) ORDER BY topic) AS body FROM b GROUP BY packet)
SELECT packet, 'A' AS stage, '' AS topic, CASE WHEN ok THEN 'complete' ELSE 'pending' END AS status, row_number() OVER (PARTITION BY body ORDER BY packet) = 1 AS provider_call FROM a
UNION ALL SELECT packet, 'B', topic, CASE WHEN ok THEN 'complete' ELSE 'pending' END, row_number() OVER (PARTITION BY body ORDER BY packet, topic) = 1 FROM b
UNION ALL SELECT packet, 'C', '', CASE WHEN ready AND ok THEN 'complete' ELSE 'pending' END, ready AND row_number() OVER (PARTITION BY ready, body ORDER BY packet) = 1 FROM c""")
def staged_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three phases over conversations as packets, with stand-in models."""
    from parley.operators.staged import staged_analysis

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("packet"), F.concat(F.lit("m"), F.col("turn")).alias("handle"), F.col("text").alias("content"))
    return staged_analysis(turns, _topics, _claims, _audit)
