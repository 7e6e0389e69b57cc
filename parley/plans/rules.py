"""Rule matching, gates, support, scores by type, and other checks over messages and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.operators.pairs import cluster_sizes, placed, rank_near_blocks
from parley.plans import scans
from parley.plans.analytics import MINUTE
from parley.plans.archive import DAY, START, M
from parley.plans.dialogue import SPLIT_PAIRS, topic_components
from parley.plans.registry import query
from parley.sources.tables import between, event_messages, table, turn_messages
from parley.streaming.state import cooldown_decisions

HOUR = 60 * MINUTE


@query(f"""WITH {M}, c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), p AS (SELECT item_id * 7 AS row_id FROM benchmark)
SELECT row_id, chat_id, us, 'range' AS how FROM m WHERE us >= {START + 3 * DAY} AND us < {START + 6 * DAY} AND chat_id IN (SELECT c_custkey FROM c)
UNION ALL SELECT row_id, chat_id, us, 'point' FROM m WHERE row_id IN (SELECT row_id FROM p)""")
def history_of_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of some chats, and single messages by id: semi-joins with what is asked for."""
    m = event_messages(spark, sf_dir)
    chats = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("chat_id"))
    ids = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("row_id"))
    some = between(m, START + 3 * DAY, START + 6 * DAY).join(chats, "chat_id", "left_semi").select("row_id", "chat_id", "us", F.lit("range").alias("how"))
    return some.unionByName(m.join(ids, "row_id", "left_semi").select("row_id", "chat_id", "us", F.lit("point").alias("how")))


@query(f"""WITH {M}, f AS (SELECT chat_id, kind, us, row_id, row_number() OVER (PARTITION BY chat_id, kind ORDER BY us, row_id) AS n FROM m)
SELECT chat_id, string_agg(kind, ',' ORDER BY us, row_id) AS kinds FROM f WHERE n = 1 GROUP BY chat_id""")
def first_seen_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct kinds of a chat in the order in which they were first seen."""
    first = event_messages(spark, sf_dir).groupBy("chat_id", "kind").agg(F.min(F.struct("us", "row_id")).alias("first"))
    kinds = F.array_sort(F.collect_list(F.struct("first", "kind")))
    return first.groupBy("chat_id").agg(F.array_join(F.transform(kinds, lambda x: x["kind"]), ",").alias("kinds"))


#: Rules by number: whether enabled, and the lists that must all be met where they are not empty.
MATCHERS = {
    1: {"types": ["en"], "any": ["with", "from"]},
    2: {"chats": ["src0", "src3"], "all": ["of", "the"]},
    3: {"types": ["de", "fr"], "patterns": ["[0-9]{6,}", "[|]"]},
    4: {"any": ["licen"], "senders": [0, 1, 2]},
    5: {},
    6: {"enabled": False, "types": ["es"]},
    7: {"all": ["@"], "types": ["en", "de", "fr", "es"]},
}


def _matcher(rule: dict) -> Column:
    text, tests = F.lower("text"), []
    tests += [F.col("lang").isin(rule["types"])] if rule.get("types") else []
    tests += [F.col("source").isin(rule["chats"])] if rule.get("chats") else []
    tests += [(F.col("doc_id") % 10).isin(rule["senders"])] if rule.get("senders") else []
    for name, join in (("any", "or"), ("all", "and")):
        found = [F.contains(text, F.lit(k)) for k in rule.get(name, ())]
        for i in range(1, len(found)):
            found[0] = found[0] | found[i] if join == "or" else found[0] & found[i]
        tests += found[:1]
    patterns = [F.col("text").rlike(f"(?i){p}") for p in rule.get("patterns", ())]
    for p in patterns[1:]:
        patterns[0] = patterns[0] | p
    tests += patterns[:1]
    out = F.lit(bool(tests) and rule.get("enabled", True))
    for t in tests:
        out = out & t
    return out


def _matcher_sql(rule: dict) -> str:
    quoted = lambda xs: ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs)
    tests = [f"lang IN ({quoted(rule['types'])})"] if rule.get("types") else []
    tests += [f"source IN ({quoted(rule['chats'])})"] if rule.get("chats") else []
    tests += [f"doc_id % 10 IN ({quoted(rule['senders'])})"] if rule.get("senders") else []
    tests += ["(" + " OR ".join(f"contains(lower(text), '{k}')" for k in rule["any"]) + ")"] if rule.get("any") else []
    tests += [f"contains(lower(text), '{k}')" for k in rule.get("all", ())]
    tests += ["(" + " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in rule["patterns"]) + ")"] if rule.get("patterns") else []
    return " AND ".join(tests) if tests and rule.get("enabled", True) else "false"


@query(f"""WITH r AS (SELECT doc_id, unnest(list_filter([{", ".join(f"CASE WHEN {_matcher_sql(r)} THEN {i} END" for i, r in MATCHERS.items())}], lambda x: x IS NOT NULL)) AS rule FROM documents)
SELECT doc_id, rule, rule = min(rule) OVER (PARTITION BY doc_id) AS first FROM r""")
def rule_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in full: types, chats, senders, any and all keywords, expressions. A disabled rule and one
    with every list empty match nothing. All rules are tested in one pass."""
    hits = F.array_compact(F.array(*[F.when(_matcher(r), F.lit(i)) for i, r in MATCHERS.items()]))
    rows = table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")).where(F.size("hits") > 0)
    return rows.select("doc_id", F.explode("hits").alias("rule"), F.array_min("hits").alias("least")).select("doc_id", "rule", (F.col("rule") == F.col("least")).alias("first"))


GATES = f"""CASE WHEN kind = 'error' THEN 'from_self' WHEN kind NOT IN ('click', 'view', 'purchase') THEN 'type' WHEN (us // {HOUR}) % 24 < 6 THEN 'quiet_hours'
  WHEN k % 4 = 0 THEN 'no_rule' END"""


@query(
    scans.cooldown(f"{M}, t AS (SELECT chat_id, us, row_id, {GATES} IS NULL AS wants, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m)", 8 * HOUR, f"SELECT m.row_id, coalesce({GATES.replace('us //', 'm.us //')}, decision) AS reason FROM s JOIN m USING (row_id)")
)
def gated_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered gates, each with its reason; what passes replies unless its chat has just had a reply."""
    m = event_messages(spark, sf_dir)
    kind, hour = F.col("kind"), F.floor(F.col("us") / HOUR) % 24
    gate = F.when(kind == "error", "from_self").when(~kind.isin("click", "view", "purchase"), "type").when(hour < 6, "quiet_hours").when(F.col("k") % 4 == 0, "no_rule")
    rows = m.withColumn("gate", gate)
    decided = cooldown_decisions(rows, candidate=F.col("gate").isNull(), cooldown_us=8 * HOUR, keep=["gate"])
    return decided.select("row_id", F.coalesce("gate", "decision").alias("reason"))


@query(f"""WITH {M}, p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m),
w AS (SELECT *, max(CASE WHEN kind = 'view' THEN pos END) OVER b AS seen, max(CASE WHEN kind = 'purchase' THEN pos END) OVER b AS between_pos FROM p
  WINDOW b AS (PARTITION BY chat_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT w.row_id, CASE WHEN w.us - v.us <= {5 * HOUR} AND coalesce(w.between_pos, 0) < w.seen THEN v.row_id END AS target
FROM w LEFT JOIN p v ON v.chat_id = w.chat_id AND v.pos = w.seen WHERE w.kind = 'click'""")
def reaction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reaction's target: the last occurrence within the limit, unless something substantive came
    between. One window gives both; nothing is joined."""
    p = placed(event_messages(spark, sf_dir))
    before = W.partitionBy("chat_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    view = F.last(F.when(F.col("kind") == "view", F.struct("pos", "row_id", "us")), ignorenulls=True).over(before)
    other = F.max(F.when(F.col("kind") == "purchase", F.col("pos"))).over(before)
    w = p.withColumn("v", view).withColumn("other", other).where("kind = 'click'")
    fits = (F.col("us") - F.col("v.us") <= 5 * HOUR) & (F.coalesce("other", F.lit(0)) < F.col("v.pos"))
    return w.select("row_id", F.when(fits, F.col("v.row_id")).alias("target"))


NINE = {
    "day": f"us // {DAY}", "weekday": f"(us // {DAY}) % 7", "hour": f"(us // {HOUR}) % 24", "entity": "k % 10", "topic": "k // 10", "kind": "kind",
    "kind_entity": "kind || ':' || (k % 10)", "price": "CASE WHEN kind = 'purchase' THEN value::BIGINT // 10 END", "thread": "CASE WHEN k % 3 = 0 THEN k END",
}


@query(f"""WITH {M}, k AS (SELECT chat_id, row_id, us, unnest([{", ".join(f"{{'r': '{n}', 'k': ({e})::VARCHAR}}" for n, e in NINE.items())}]) AS p FROM m),
x AS (SELECT chat_id, row_id, p.r AS r, p.k AS k, row_number() OVER (PARTITION BY chat_id, p.r, p.k ORDER BY us, row_id) AS n FROM k WHERE p.k IS NOT NULL)
SELECT a.row_id AS a, b.row_id AS b, string_agg(DISTINCT a.r, ',' ORDER BY a.r) AS reasons FROM x a JOIN x b ON a.chat_id = b.chat_id AND a.r = b.r AND a.k = b.k AND b.n > a.n AND b.n <= a.n + 2 GROUP BY 1, 2""")
def block_pairs_nine_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs under nine blocking keys, at most two ranks apart under one of them."""
    day, kind, k = F.floor(F.col("us") / DAY), F.col("kind"), F.col("k")
    keys = {
        "day": day, "weekday": day % 7, "hour": F.floor(F.col("us") / HOUR) % 24, "entity": k % 10, "topic": F.floor(k / 10), "kind": kind,
        "kind_entity": F.concat_ws(":", kind, k % 10), "price": F.when(kind == "purchase", F.floor(F.rint("value") / 10)), "thread": F.when(k % 3 == 0, k),
    }
    return rank_near_blocks(event_messages(spark, sf_dir), keys, 2, "chat_id", ["us", "row_id"], "row_id")


#: Topics and the words by which texts name them; the order decides between equal counts.
TOPICS = {"means": ["with", "avec", "con", "mit"], "purpose": ["for", "pour", "para", "zu"], "state": ["is", "est", "es", "ist"], "origin": ["from", "de", "von"]}


def _named(names: list[str]) -> Column:
    """How many of the words ``w`` are one of the names."""
    return F.size(F.filter("w", lambda x: x.isin(names)))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
c AS (SELECT doc_id, [{", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(a) for a in names)})))" for names in TOPICS.values())}] AS n FROM w)
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN n[{i + 1}] > 0 THEN '{t}' END" for i, t in enumerate(TOPICS))}], lambda x: x IS NOT NULL), ',') AS topics,
  CASE WHEN list_max(n) > 0 THEN [{", ".join(f"'{t}'" for t in TOPICS)}][list_position(n, list_max(n))] END AS primary_topic FROM c""")
def topic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that a text names by any alias, and the one it names most."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    counts = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", *[_named(names).alias(t) for t, names in TOPICS.items()])
    most = F.greatest(*TOPICS)
    primary = F.when(most > 0, F.coalesce(*[F.when(F.col(t) == most, t) for t in TOPICS]))
    return counts.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(t) > 0, t) for t in TOPICS])), ",").alias("topics"), primary.alias("primary_topic"))


@query("""WITH w AS (SELECT page_id, unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\\p{L}+')) AS w FROM pages),
s AS (SELECT page_id, w, unnest(range(2, 6)) AS n FROM w), g AS (SELECT DISTINCT page_id, n, w[i : i + n - 1] AS gram FROM (SELECT *, unnest(range(1, length(w) - n + 2)) AS i FROM s WHERE length(w) >= n))
SELECT n, gram, count(*) AS pages FROM g GROUP BY n, gram HAVING count(*) >= 3""")
def title_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character n-grams of two to five letters inside the words of titles that three pages share."""
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    w = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(title, F.lit("\\p{L}+"), F.lit(0))).alias("w"))
    s = w.select("page_id", "w", F.explode(F.array(*map(F.lit, range(2, 6))).cast("array<long>")).alias("n")).where(F.length("w") >= F.col("n"))
    grams = F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n").cast("int") + 1), lambda i: F.substring(F.col("w"), i, F.col("n").cast("int")))
    g = s.select("page_id", "n", F.explode(grams).alias("gram")).distinct()
    return g.groupBy("n", "gram").agg(F.count("*").alias("pages")).where("pages >= 3")


CAUSAL = "(?i)(?:^|[^a-z])(?:that|que|dass|pour|for)(?:[^a-z]|$)"


@query(f"""WITH t AS (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) AS w FROM conversations),
l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS ev FROM t)
SELECT conv_id AS chat_id, turn AS pos, len(w) AS tokens, len(list_intersect(w, ev)) AS shared, regexp_matches(text, '{CAUSAL}') AS causal,
  CASE WHEN len(list_intersect(w, ev)) = 0 THEN 'unsupported' WHEN regexp_matches(text, '{CAUSAL}') AND len(list_intersect(w, ev)) < 2 THEN 'causal_unsupported' ELSE 'supported' END AS verdict
FROM l WHERE ev IS NOT NULL""")
def token_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a turn the one before it says too; a causal claim needs more than one shared word."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("\\p{L}{4,}"), F.lit(0)))
    before = F.lag("w").over(W.partitionBy("chat_id").orderBy("pos"))
    rows = turn_messages(spark, sf_dir).select("chat_id", "pos", w.alias("w"), F.col("content").rlike(CAUSAL).alias("causal")).withColumn("ev", before).where("ev IS NOT NULL")
    rows = rows.withColumn("shared", F.size(F.array_intersect("w", "ev")).cast("long"))
    verdict = F.when(F.col("shared") == 0, "unsupported").when(F.col("causal") & (F.col("shared") < 2), "causal_unsupported").otherwise("supported")
    return rows.select("chat_id", "pos", F.size("w").cast("long").alias("tokens"), "shared", "causal", verdict.alias("verdict"))


@query("""WITH s AS (SELECT event_id AS row_id, 'Here it is: ' || CASE WHEN event_id % 13 = 0 THEN replace(props, '}', '') WHEN event_id % 17 = 0 THEN '{"k": "many"}' WHEN event_id % 19 = 0 THEN '{"z": 1}' ELSE props END || ' - done.' AS said FROM events),
o AS (SELECT row_id, nullif(regexp_extract(said, '[{][^{}]*[}]'), '') AS body FROM s)
SELECT row_id, CASE WHEN body IS NULL THEN 'no_object' WHEN json_extract(body, '$.k') IS NULL THEN 'shape' WHEN TRY_CAST(json_extract_string(body, '$.k') AS INTEGER) IS NULL THEN 'type' ELSE 'ok' END AS outcome,
  TRY_CAST(json_extract_string(body, '$.k') AS INTEGER) AS k FROM o""")
def prose_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object taken out of the prose around it and checked for shape and type."""
    i, props = F.col("event_id"), F.col("props")
    said = F.concat(F.lit("Here it is: "), F.when(i % 13 == 0, F.replace(props, F.lit("}"), F.lit(""))).when(i % 17 == 0, '{"k": "many"}').when(i % 19 == 0, '{"z": 1}').otherwise(props), F.lit(" - done."))
    body = F.nullif(F.regexp_extract(said, "[{][^{}]*[}]", 0), F.lit(""))
    rows = table(spark, sf_dir, "events").select(i.alias("row_id"), body.alias("body")).withColumn("raw", F.get_json_object("body", "$.k"))
    k = F.col("raw").try_cast("int")
    outcome = F.when(F.col("body").isNull(), "no_object").when(F.col("raw").isNull(), "shape").when(k.isNull(), "type").otherwise("ok")
    return rows.select("row_id", outcome.alias("outcome"), k.alias("k"))


@query("""WITH d AS (SELECT 2 * quality + toxic AS gold, CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 5 = 0 THEN (2 * quality + toxic + 1) % 4 ELSE 2 * quality + toxic END AS pred FROM labels JOIN documents USING (doc_id))
SELECT gold AS type, count(*) AS n, count(*) FILTER (pred = gold) AS right_ones, count(*) FILTER (pred IS NULL) AS missing, count(*) FILTER (pred <> gold AND pred = 3) AS over_merged,
  round(count(*) FILTER (pred = gold) / count(*), 6) AS accuracy FROM d GROUP BY gold""")
def typed_relation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by type, with predictions that are missing or merge too much."""
    gold, n = 2 * F.col("quality") + F.col("toxic"), F.col("n_chars")
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    d = d.select(gold.alias("type"), F.when(n % 7 == 0, None).when(n % 5 == 0, (gold + 1) % 4).otherwise(gold).alias("pred"))
    right = F.count_if(F.col("pred") == F.col("type"))
    return d.groupBy("type").agg(
        F.count("*").alias("n"), right.alias("right_ones"), F.count_if(F.col("pred").isNull()).alias("missing"),
        F.count_if((F.col("pred") != F.col("type")) & (F.col("pred") == 3)).alias("over_merged"), F.round(right / F.count("*"), 6).alias("accuracy"),
    )


@query("""WITH c AS (SELECT vec_id % 13 AS pred, label AS gold, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY pred) AS np, sum(n) OVER (PARTITION BY gold) AS ng FROM c),
j AS (SELECT *, n / (np + ng - n) AS jaccard, row_number() OVER (PARTITION BY gold ORDER BY n / (np + ng - n) DESC, pred) AS place FROM s)
SELECT gold, pred, n AS shared, round(jaccard, 6) AS jaccard FROM j WHERE place = 1""")
def cluster_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted cluster that fits each gold one best, by Jaccard of their cells' counts."""
    x = table(spark, sf_dir, "embeddings").select(F.col("label").alias("gold"), (F.col("vec_id") % 13).alias("pred"))
    s = cluster_sizes(x, "pred", "gold").withColumn("jaccard", F.col("n") / (F.col("np") + F.col("ng") - F.col("n")))
    best = s.groupBy("gold").agg(F.max_by(F.struct("pred", "n", "jaccard"), F.struct("jaccard", -F.col("pred"))).alias("b"))
    return best.select("gold", "b.pred", F.col("b.n").alias("shared"), F.round("b.jaccard", 6).alias("jaccard"))


@query("""WITH l AS (SELECT l_orderkey AS claim, l_partkey AS acu, l_linenumber % 4 = l_partkey % 4 AS slot, min(l_orderkey) OVER (PARTITION BY l_partkey) AS first FROM lineitem),
c AS (SELECT claim, bool_and(acu % 3 = 2) AS trivial, count(*) FILTER (first < claim) AS redundant, count(*) AS refs, count(*) FILTER (slot) AS slots FROM l GROUP BY claim)
SELECT count(*) AS claims, count(*) FILTER (trivial) AS trivial, count(*) FILTER (redundant = refs) AS redundant, round(sum(slots) / nullif(sum(refs), 0), 6) AS slot_accuracy FROM c""")
def acu_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trivial and redundant claims, and the accuracy of their slots; null without references."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("acu"), (F.col("l_linenumber") % 4 == F.col("l_partkey") % 4).alias("slot"))  # noqa: E741
    first = l.groupBy("acu").agg(F.min("claim").alias("first"))
    c = l.join(first, "acu").groupBy("claim").agg(
        F.bool_and(F.col("acu") % 3 == 2).alias("trivial"), F.count_if(F.col("first") < F.col("claim")).alias("redundant"), F.count("*").alias("refs"), F.count_if("slot").alias("slots")
    )
    return c.agg(
        F.count("*").alias("claims"), F.count_if("trivial").alias("trivial"), F.count_if(F.col("redundant") == F.col("refs")).alias("redundant"),
        F.round(F.sum("slots") / F.nullif(F.sum("refs"), F.lit(0)), 6).alias("slot_accuracy"),
    )


@query("""WITH d AS (SELECT doc_id, quality AS va, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS vb, CASE WHEN doc_id % 2 = 0 THEN 1 END AS override FROM labels)
SELECT count(*) AS labels, count(*) FILTER (va = vb AND override IS NULL) AS agreed, count(override) AS overridden, count(*) FILTER (va <> vb AND override IS NULL) AS unresolved,
  CASE WHEN count(*) FILTER (va <> vb AND override IS NULL) > 0 THEN 'blocked' ELSE 'frozen' END AS gate, min(doc_id) FILTER (va <> vb AND override IS NULL) AS first_unresolved FROM d""")
def freeze_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides win over both annotators; a set with an unresolved conflict is not frozen."""
    q, i = F.col("quality"), F.col("doc_id")
    d = table(spark, sf_dir, "labels").select("doc_id", (F.when(i % 7 == 0, 1 - q).otherwise(q) == q).alias("same"), (i % 2 == 0).alias("override"))
    open_ = ~F.col("same") & ~F.col("override")
    return d.agg(
        F.count("*").alias("labels"), F.count_if(F.col("same") & ~F.col("override")).alias("agreed"), F.count_if("override").alias("overridden"), F.count_if(open_).alias("unresolved"),
        F.when(F.count_if(open_) > 0, "blocked").otherwise("frozen").alias("gate"), F.min(F.when(open_, i)).alias("first_unresolved"),
    )


@query(f"""WITH {M}, w AS (SELECT row_id, kind, bit_or(CASE WHEN kind = 'click' THEN 1 << (k % 10) ELSE 0 END) OVER a AS families, bool_or(kind = 'signup') OVER a AS replied,
  bit_or(CASE WHEN kind = 'purchase' THEN 1 << (k % 10) ELSE 0 END) OVER a AS objects FROM m
  WINDOW a AS (PARTITION BY chat_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {24 * HOUR} FOLLOWING))
SELECT row_id, CASE WHEN coalesce(replied, false) THEN 'replied' WHEN bit_count(coalesce(families, 0)) >= 2 THEN 'awaiting_reply' ELSE 'open' END AS status,
  bit_count(coalesce(families, 0)) >= 2 AND bit_count(coalesce(objects, 0)) >= 2 AS competing FROM w WHERE kind = 'view'""")
def reply_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that wait for a reply: two families of continuations in a day and none that answers.
    They compete if two objects were named as well. Sets of families are bits."""
    after = W.partitionBy("chat_id").orderBy("us").rangeBetween(1, 24 * HOUR)
    bits = lambda kind: F.coalesce(F.bit_or(F.when(F.col("kind") == kind, F.expr("shiftleft(1, cast(k % 10 AS int))")).otherwise(0)).over(after), F.lit(0))
    replied = F.coalesce(F.bool_or(F.col("kind") == "signup").over(after), F.lit(False))
    rows = event_messages(spark, sf_dir).withColumn("families", F.bit_count(bits("click"))).withColumn("objects", F.bit_count(bits("purchase"))).withColumn("replied", replied).where("kind = 'view'")
    status = F.when(F.col("replied"), "replied").when(F.col("families") >= 2, "awaiting_reply").otherwise("open")
    return rows.select("row_id", status.alias("status"), ((F.col("families") >= 2) & (F.col("objects") >= 2)).alias("competing"))


@query(f"""WITH RECURSIVE {SPLIT_PAIRS}, e AS (SELECT a AS x, b AS y FROM h WHERE NOT split UNION SELECT b, a FROM h WHERE NOT split),
r AS (SELECT x AS i, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.i), k AS (SELECT i, min(c) AS event FROM r GROUP BY i),
n AS (SELECT event, row_id, us, kind, row_number() OVER (PARTITION BY event ORDER BY us, row_id) AS n, count(*) OVER (PARTITION BY event) AS claims FROM k JOIN m ON m.row_id = i)
SELECT event, claims, string_agg(upper(kind[1]) || kind[2:] || ' (' || row_id || ').', ' ' ORDER BY n) AS card, string_agg(row_id, ',' ORDER BY n) AS bound FROM n WHERE n <= 3 GROUP BY event, claims""")
def presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for every event: its first three claims as sentences, each bound to the claim it tells."""
    roots = topic_components(spark, sf_dir).select(F.col("id").alias("row_id"), F.col("root").alias("event"))
    rows = roots.join(event_messages(spark, sf_dir), "row_id")
    n = F.row_number().over(W.partitionBy("event").orderBy("us", "row_id"))
    claims = rows.groupBy("event").agg(F.count("*").alias("claims"))
    first = rows.withColumn("n", n).where("n <= 3").groupBy("event").agg(F.array_sort(F.collect_list(F.struct("n", "kind", "row_id"))).alias("x"))
    sentence = F.transform("x", lambda c: F.concat(F.initcap(c["kind"]), F.lit(" ("), c["row_id"], F.lit(").")))
    bound = F.transform("x", lambda c: c["row_id"].cast("string"))
    return first.join(claims, "event").select("event", "claims", F.array_join(sentence, " ").alias("card"), F.array_join(bound, ",").alias("bound"))


@query(f"""WITH t AS (SELECT max(epoch_us(o_orderdate)) AS now FROM orders)
SELECT o_orderkey AS call_id, CASE WHEN o_orderstatus = 'P' THEN 'reserved' WHEN o_orderstatus = 'F' THEN 'complete' WHEN now - epoch_us(o_orderdate) > {30 * DAY} THEN 'abandoned' ELSE 'started' END AS state,
  CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 2) ELSE 0 END AS charged FROM orders, t""")
def call_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durable calls: reserved, started, complete, or abandoned when thirty days have passed since."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", at.alias("us"))
    now = o.agg(F.max("us")).first()[0] or 0
    status = F.col("o_orderstatus")
    state = F.when(status == "P", "reserved").when(status == "F", "complete").when(F.lit(now) - F.col("us") > 30 * DAY, "abandoned").otherwise("started")
    return o.select(F.col("o_orderkey").alias("call_id"), state.alias("state"), F.when(status == "F", F.round("o_totalprice", 2)).otherwise(0.0).alias("charged"))


CONTRACT = {
    "documents": {"id_null": "doc_id IS NULL", "text_null": "text IS NULL", "length": "length(text) <> n_chars", "lang_enum": "lang NOT IN ('en', 'de', 'fr', 'es')", "source_form": "NOT regexp_like(source, '^src[0-9]+$')"},
    "labels": {"quality_enum": "quality NOT IN (0, 1)", "toxic_enum": "toxic NOT IN (0, 1)"},
    "events": {"value_sign": "value < 0", "kind_enum": "event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')", "time_null": "ts IS NULL"},
    "conversations": {"role_enum": "role NOT IN ('user', 'assistant', 'system')", "turn_sign": "turn < 0", "empty_text": "text IS NULL OR length(text) = 0"},
    "benchmark": {"empty_item": "text IS NULL OR length(text) = 0"},
}


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS dataset, '{n}' AS rule, count(*) FILTER ({r.replace('regexp_like', 'regexp_matches')}) AS violations FROM {t}" for t, rules in CONTRACT.items() for n, r in rules.items())
    + " UNION ALL SELECT 'labels', 'unknown_document', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)"
    + " UNION ALL SELECT 'conversations', 'turn_gap', count(*) FROM (SELECT turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations) WHERE g <> 1"
    + " UNION ALL SELECT 'documents', 'repeated_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)"
)
def dataset_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each dataset's contract: forms and enumerations in one pass a table, references by
    anti-join, gaps by a window."""
    out = None
    for name, rules in CONTRACT.items():
        sums = table(spark, sf_dir, name).agg(*[F.count_if(F.expr(r)).alias(n) for n, r in rules.items()]).unpivot([], list(rules), "rule", "violations")
        part = sums.select(F.lit(name).alias("dataset"), "rule", "violations")
        out = part if out is None else out.unionByName(part)
    labels, documents, turns = (table(spark, sf_dir, t) for t in ("labels", "documents", "conversations"))
    unknown = labels.join(documents.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("violations"))
    gap = F.col("turn") - F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn"))
    gaps = turns.select(gap.alias("g")).agg(F.count_if(F.col("g") != 1).alias("violations"))
    repeated = documents.groupBy("doc_id").count().agg(F.count_if(F.col("count") > 1).alias("violations"))
    for name, rule, found in (("labels", "unknown_document", unknown), ("conversations", "turn_gap", gaps), ("documents", "repeated_id", repeated)):
        out = out.unionByName(found.select(F.lit(name).alias("dataset"), F.lit(rule).alias("rule"), "violations"))
    return out
