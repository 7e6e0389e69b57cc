"""Predicted spans against gold ones, and the contract of all tables with its graph rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.operators import contract
from parley.operators.graph import checkpointed
from parley.operators.pairs import neighbours, placed
from parley.operators.spans import alike, crossing, overlaps
from parley.plans.analytics import MINUTE
from parley.plans.archive import M
from parley.plans.dialogue import fragments
from parley.plans.registry import ORACLES, query
from parley.sources.tables import event_messages, table, turn_messages

HOUR = 60 * MINUTE
SPAN = ["chat_id", "pos"]
ALIKE = 50


def altered(gold: DataFrame) -> DataFrame:
    """A copy as a model might bring it: some clauses missing, shifted, cut in two, of another state or actor."""
    h = (F.col("chat_id") * 31 + F.col("pos") * 7 + F.col("start")) % 11
    size = F.col("stop") - F.col("start")
    rows = gold.withColumn("h", h).where("h <> 0").withColumn("half", F.explode(F.when((F.col("h") == 3) & (size >= 8), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    middle = F.col("start") + F.floor(size / 2)
    start = F.when(F.col("half") == 2, middle).when((F.col("h") == 1) & (size >= 4), F.col("start") + F.floor(size / 4)).otherwise(F.col("start"))
    stop = F.when(F.col("half") == 1, middle).otherwise(F.col("stop"))
    return rows.select(*SPAN, start.alias("start"), stop.alias("stop"), F.when(F.col("h") == 2, "other").otherwise(F.col("state")).alias("state"), F.when(F.col("h") == 4, "nobody").otherwise(F.col("actor")).alias("actor"))


def score_spans(gold: DataFrame, found: DataFrame) -> DataFrame:
    """metric, gold, predicted, hits of spans (chat_id, pos, start, stop, state, actor): mentions that are equal, that are
    alike by overlap, claims by their keys with their speakers, and pairs of neighbours as candidates."""
    key = [*SPAN, "start", "stop"]

    def row(metric: str, g: DataFrame, p: DataFrame, hits: DataFrame) -> DataFrame:
        one = lambda df, name: df.agg(F.count("*").alias(name))
        return one(g, "gold").crossJoin(one(p, "predicted")).crossJoin(one(hits, "hits")).select(F.lit(metric).alias("metric"), "gold", "predicted", "hits")  # single rows

    def follow(spans: DataFrame) -> DataFrame:
        order = W.partitionBy(*SPAN).orderBy("start", "stop")
        return spans.select(*SPAN, F.col("start").alias("left"), F.lead("start").over(order).alias("right")).where("right IS NOT NULL").distinct()

    near = overlaps(gold.select(*key).distinct(), found.select(*key).distinct(), SPAN).where(alike(ALIKE))
    g, p = gold.select(*key).distinct(), found.select(*key).distinct()
    exact = gold.select(*key, "state").distinct().join(found.select(*key, "state").distinct(), [*key, "state"])
    said = gold.select(*key, "actor").distinct().join(found.select(*key, "actor").distinct(), [*key, "actor"])
    pairs, other = follow(gold), follow(found)
    rows = [
        row("mention", gold.select(*key, "state").distinct(), found.select(*key, "state").distinct(), exact), row("overlap", g, p, near.select(*SPAN, "a_start", "a_stop").distinct()), row("claim", g, p, g.join(p, key)),
        row("speaker", g, p, said), row("candidate", pairs, other, pairs.join(other, [*SPAN, "left", "right"])),
    ]
    share = lambda of: F.when(F.col(of) == 0, 1.0).otherwise(F.round(F.col("hits") / F.col(of), 6))
    return contract.all_of(rows).withColumns({"precision": share("predicted"), "recall": share("gold")}).withColumn("f1", F.when(F.col("gold") + F.col("predicted") == 0, 1.0).otherwise(F.round(2 * F.col("hits") / (F.col("gold") + F.col("predicted")), 6)))


ALTERED = f"""gold AS (SELECT chat_id, pos, start, stop, state, actor FROM ({ORACLES["context_fragments"]})),
z AS (SELECT *, (chat_id * 31 + pos * 7 + start) % 11 AS h, stop - start AS size FROM gold),
y AS (SELECT *, unnest(CASE WHEN h = 3 AND size >= 8 THEN [1, 2] ELSE [0] END) AS half FROM z WHERE h <> 0),
found AS (SELECT chat_id, pos, CASE WHEN half = 2 THEN start + size // 2 WHEN h = 1 AND size >= 4 THEN start + size // 4 ELSE start END AS start,
  CASE WHEN half = 1 THEN start + size // 2 ELSE stop END AS stop, CASE WHEN h = 2 THEN 'other' ELSE state END AS state, CASE WHEN h = 4 THEN 'nobody' ELSE actor END AS actor FROM y)"""
GOLD = f"""{ALTERED},
g AS (SELECT DISTINCT chat_id, pos, start, stop FROM gold), p AS (SELECT DISTINCT chat_id, pos, start, stop FROM found),
gf AS (SELECT DISTINCT chat_id, pos, l, r FROM (SELECT chat_id, pos, start AS l, lead(start) OVER (PARTITION BY chat_id, pos ORDER BY start, stop) AS r FROM gold) WHERE r IS NOT NULL),
pf AS (SELECT DISTINCT chat_id, pos, l, r FROM (SELECT chat_id, pos, start AS l, lead(start) OVER (PARTITION BY chat_id, pos ORDER BY start, stop) AS r FROM found) WHERE r IS NOT NULL),
m AS (SELECT 'mention' AS metric, (SELECT count(*) FROM (SELECT DISTINCT chat_id, pos, start, stop, state FROM gold)) AS gold, (SELECT count(*) FROM (SELECT DISTINCT chat_id, pos, start, stop, state FROM found)) AS predicted,
  (SELECT count(*) FROM (SELECT chat_id, pos, start, stop, state FROM gold INTERSECT SELECT chat_id, pos, start, stop, state FROM found)) AS hits
UNION ALL SELECT 'overlap', (SELECT count(*) FROM g), (SELECT count(*) FROM p), (SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.chat_id = g.chat_id AND p.pos = g.pos AND least(p.stop, g.stop) > greatest(p.start, g.start)
  AND 100 * (least(p.stop, g.stop) - greatest(p.start, g.start)) >= {ALIKE} * (greatest(p.stop, g.stop) - least(p.start, g.start))))
UNION ALL SELECT 'claim', (SELECT count(*) FROM g), (SELECT count(*) FROM p), (SELECT count(*) FROM (FROM g INTERSECT FROM p))
UNION ALL SELECT 'speaker', (SELECT count(*) FROM g), (SELECT count(*) FROM p), (SELECT count(*) FROM (SELECT chat_id, pos, start, stop, actor FROM gold INTERSECT SELECT chat_id, pos, start, stop, actor FROM found))
UNION ALL SELECT 'candidate', (SELECT count(*) FROM gf), (SELECT count(*) FROM pf), (SELECT count(*) FROM (FROM gf INTERSECT FROM pf)))"""


@query(f"""WITH {GOLD} SELECT *, CASE WHEN predicted = 0 THEN 1.0 ELSE round(hits / predicted, 6) END AS precision, CASE WHEN gold = 0 THEN 1.0 ELSE round(hits / gold, 6) END AS recall,
  CASE WHEN gold + predicted = 0 THEN 1.0 ELSE round(2 * hits / (gold + predicted), 6) END AS f1 FROM m""")
def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of clauses found by an altered copy: equal ones, overlapping ones, claims, speakers, candidates."""
    gold = fragments(turn_messages(spark, sf_dir)).select(*SPAN, "start", "stop", "state", "actor")
    return score_spans(gold, altered(gold))


#: Predicates of rows that break the contract, by table.
ROWS = {
    "documents": {"id_null": "doc_id IS NULL", "text_null": "text IS NULL", "length": "length(text) <> n_chars", "lang_enum": "lang NOT IN ('en', 'de', 'fr', 'es')", "no_letter": "NOT regexp_like(coalesce(text, ''), '[A-Za-z]')", "shouting": "upper(text) = text AND lower(text) <> text"},
    "labels": {"quality_enum": "quality NOT IN (0, 1)", "toxic_enum": "toxic NOT IN (0, 1)", "both_null": "quality IS NULL AND toxic IS NULL", "toxic_and_good": "toxic = 1 AND quality = 1"},
    "events": {"value_sign": "value < 0", "kind_enum": "event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')", "time_null": "ts IS NULL", "user_null": "user_id IS NULL", "free_purchase": "event_type = 'purchase' AND value < 1", "props_form": "props NOT LIKE '{%}'"},
    "conversations": {"role_enum": "role NOT IN ('user', 'assistant', 'system')", "turn_sign": "turn < 0", "empty_text": "text IS NULL OR length(text) = 0", "late_system": "role = 'system' AND turn > 0", "first_not_user": "turn = 0 AND role = 'assistant'", "very_long": "length(text) > 1500"},
    "benchmark": {"empty_item": "text IS NULL OR length(text) = 0", "short_item": "length(text) < 60"},
    "pages": {"url_form": "NOT regexp_like(url, '^https?://')", "html_null": "html IS NULL", "no_title": "NOT contains(html, '<title>')", "no_body": "NOT contains(html, '<body')"},
    "orders": {"status_enum": "o_orderstatus NOT IN ('F', 'O', 'P')", "price_sign": "o_totalprice <= 0", "date_null": "o_orderdate IS NULL", "high_price": "o_totalprice > 400000"},
    "lineitem": {"quantity_range": "l_quantity < 1 OR l_quantity > 50", "discount_range": "l_discount < 0 OR l_discount > 0.1", "tax_range": "l_tax < 0 OR l_tax > 0.08", "full_discount": "l_discount = 0.1", "flag_enum": "l_returnflag NOT IN ('A', 'N', 'R')"},
    "customer": {"name_null": "c_name IS NULL", "in_debt": "c_acctbal < 0"},
}
KEYS = {"documents": ["doc_id"], "events": ["event_id"], "conversations": ["conv_id", "turn"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_partkey"]}
REFS = [("labels", "doc_id", "documents", "doc_id"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("events", "user_id", "customer", "c_custkey")]


def topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one topic, and whether they must stay apart."""
    x = neighbours(placed(event_messages(spark, sf_dir)).select("chat_id", "row_id", "us", "kind", "k", "pos"), 2)
    split = (F.col("a_kind") != F.col("b_kind")) & (F.col("b_us") - F.col("a_us") > 30 * HOUR)
    return x.where("a_k % 5 = b_k % 5").select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"), split.alias("apart"))


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ref: what a message refers to, one to three places back, but some two places on."""
    order = W.partitionBy("chat_id").orderBy("us", "row_id")
    m = event_messages(spark, sf_dir)
    back: Column = F.when(F.col("k") % 3 == 0, F.lag("row_id", 1).over(order)).when(F.col("k") % 3 == 1, F.lag("row_id", 2).over(order)).otherwise(F.lag("row_id", 3).over(order))
    return m.select(F.col("row_id").alias("id"), F.when(F.col("k") % 17 == 0, F.lead("row_id", 2).over(order)).otherwise(back).alias("ref"))


def _duck(rule: str) -> str:
    return rule.replace("regexp_like", "regexp_matches")


GRAPH = f"""{M}, p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m),
h AS (SELECT a.row_id AS a, b.row_id AS b, a.kind <> b.kind AND b.us - a.us > {30 * HOUR} AS apart FROM p a JOIN p b ON a.chat_id = b.chat_id AND b.pos > a.pos AND b.pos <= a.pos + 2 AND a.k % 5 = b.k % 5),
s AS (SELECT a AS x, b AS y FROM h WHERE NOT apart UNION SELECT b, a FROM h WHERE NOT apart), r AS (SELECT x AS i, x AS c FROM s UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.i),
o AS (SELECT i, min(c) AS root FROM r GROUP BY i),
f AS (SELECT row_id AS id, CASE WHEN k % 17 = 0 THEN lead(row_id, 2) OVER w WHEN k % 3 = 0 THEN lag(row_id, 1) OVER w WHEN k % 3 = 1 THEN lag(row_id, 2) OVER w ELSE lag(row_id, 3) OVER w END AS ref
  FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY us, row_id)),
q AS (SELECT id, ref FROM f WHERE ref IS NOT NULL UNION SELECT q.id, f.ref FROM q JOIN f ON f.id = q.ref WHERE f.ref IS NOT NULL)"""


@query(f"WITH RECURSIVE {GRAPH}, {ALTERED} "
    + " UNION ALL ".join(f"SELECT '{t}' AS dataset, '{n}' AS rule, count(*) FILTER ({_duck(r)}) AS violations FROM {t}" for t, rules in ROWS.items() for n, r in rules.items())
    + "".join(f" UNION ALL SELECT '{t}', 'repeated_key', count(*) FROM (SELECT 1 FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for t, k in KEYS.items())
    + "".join(f" UNION ALL SELECT '{t}', 'unknown_{u}', count(*) FROM {t} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {u} y WHERE y.{d} = x.{c})" for t, c, u, d in REFS)
    + """ UNION ALL SELECT 'conversations', 'turn_gap', count(*) FROM (SELECT turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations) WHERE g <> 1
UNION ALL SELECT 'relations', 'linked_apart', count(*) FROM h JOIN o x ON x.i = h.a JOIN o y ON y.i = h.b WHERE h.apart AND x.root = y.root
UNION ALL SELECT 'references', 'cycle', count(*) FROM q WHERE id = ref
UNION ALL SELECT 'spans', 'crossing', count(*) FROM (SELECT DISTINCT chat_id, pos, start, stop FROM (SELECT chat_id, pos, start, stop FROM gold UNION ALL SELECT chat_id, pos, start, stop + 3 FROM found)) a
  JOIN (SELECT DISTINCT chat_id, pos, start, stop FROM (SELECT chat_id, pos, start, stop FROM gold UNION ALL SELECT chat_id, pos, start, stop + 3 FROM found)) b
  ON a.chat_id = b.chat_id AND a.pos = b.pos AND a.start < b.start AND b.start < a.stop AND a.stop < b.stop""")
def contract_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the contract of all tables: rows, keys, references, gaps, spans that cross, pairs kept apart that links
    join all the same, and cycles of references."""
    t = {name: table(spark, sf_dir, name) for name in (*ROWS, *(u for _, _, u, _ in REFS))}
    parts = [contract.row_rules(t[name], name, rules) for name, rules in ROWS.items()]
    parts += [contract.repeated(t[name], name, "repeated_key", keys) for name, keys in KEYS.items()]
    parts += [contract.dangling(t[name], name, f"unknown_{other}", key, t[other], other_key) for name, key, other, other_key in REFS]
    gap = F.col("turn") - F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn"))
    parts.append(contract.counted(t["conversations"].select(gap.alias("g")).where("g <> 1"), "conversations", "turn_gap"))
    pairs = topic_pairs(spark, sf_dir)
    parts.append(contract.linked_apart(pairs.where("NOT apart"), pairs.where("apart").select("a", "b"), "relations", "linked_apart"))
    parts.append(contract.reference_cycles(pointers(spark, sf_dir), "references", "cycle"))
    gold = fragments(turn_messages(spark, sf_dir)).select(*SPAN, "start", "stop", "state", "actor")
    gold = checkpointed(gold)  # clauses are cut once for the four places that read them
    spans = gold.select(*SPAN, "start", "stop").union(altered(gold).select(*SPAN, "start", F.col("stop") + 3)).distinct()
    parts.append(contract.counted(crossing(spans, SPAN), "spans", "crossing"))
    return contract.all_of(parts)
