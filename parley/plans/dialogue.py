"""Fragments, details, episodes, editorial choice, judgements, invariants and worker runs."""

from __future__ import annotations

from functools import reduce

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.operators.graph import components
from parley.operators.islands import adaptive_cutoffs, gap_sessions
from parley.operators.model import apply_pair_model
from parley.operators.pairs import neighbours, placed
from parley.operators.thinning import thinned
from parley.plans.analytics import MINUTE, SCORED, _session_sql, scored_documents
from parley.plans.archive import M
from parley.plans.registry import ORACLES, query
from parley.sources.tables import event_messages, table, turn_messages

HOUR = 60 * MINUTE

#: Word classes for the invented prose of the test tables: RE2 and Java read them alike.
DONE = "(?i)(?:^|[^a-z])(?:was|fue|war)(?:[^a-z]|$)"
ONGOING = "(?i)(?:^|[^a-z])(?:is|ist|est)(?:[^a-z]|$)"
PURPOSE = "(?i)(?:^|[^a-z])(?:for|pour|para|zu)(?:[^a-z]|$)"
HEDGED = "(?i)(?:^|[^a-z])(?:that|que|dass)(?:[^a-z]|$)"
MEANS = "(?i)(?:^|[^a-z])(?:with|avec|con|mit)(?:[^a-z]|$)"
BROKEN = "%%%|[|]|!!"
OBJECT = "\\p{L}{9,}"
ACTOR = "\\p{Lu}\\p{Ll}{5,}"
PIECE = "[^.!?\\n]+[.!?\\n]*|[.!?\\n]+"


FRAGMENTS = f"""
p AS (SELECT conv_id AS chat_id, turn AS pos, role, unnest(regexp_extract_all(text, '{PIECE}')) AS piece,
  generate_subscripts(regexp_extract_all(text, '{PIECE}'), 1) AS i FROM conversations),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY chat_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(piece, '[.!?\\n]+$', ''), '^ +', '') AS clause, length(regexp_extract(piece, '^ *'))::BIGINT AS lead FROM o),
f AS (SELECT chat_id, pos, offs + lead AS start, offs + lead + length(clause) AS stop, coalesce(nullif(regexp_extract(clause, '{ACTOR}'), ''), role) AS actor,
  nullif(regexp_extract(clause, '{OBJECT}'), '') AS own,
  CASE WHEN regexp_matches(clause, '{DONE}') THEN 'done' WHEN regexp_matches(clause, '{ONGOING}') THEN 'ongoing' ELSE 'unknown' END AS state,
  CASE WHEN regexp_matches(piece, '[?]') THEN 'ask' WHEN role = 'user' AND regexp_matches(clause, '{PURPOSE}') THEN 'request'
    WHEN role = 'assistant' AND regexp_matches(clause, '{ONGOING}') THEN 'answer' ELSE 'inform' END AS intent,
  CASE WHEN regexp_matches(clause, '{HEDGED}') THEN 'hedged' WHEN regexp_matches(piece, '!') THEN 'urgent' ELSE 'stated' END AS modality
  FROM c WHERE length(clause) > 0)"""


@query(f"""WITH {FRAGMENTS}
SELECT chat_id, pos, start, stop, actor, state, intent, modality, own IS NULL AS carried,
  coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY pos, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS object
FROM f""")
def context_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with exact half-open spans, each with actor, object, state, intent and modality. A
    clause without an object takes the last one named in its chat."""
    f = fragments(turn_messages(spark, sf_dir))
    before = W.partitionBy("chat_id").orderBy("pos", "start").rowsBetween(W.unboundedPreceding, -1)
    told = F.coalesce("own", F.last("own", ignorenulls=True).over(before))
    return f.select("chat_id", "pos", "start", "stop", "actor", "state", "intent", "modality", F.col("own").isNull().alias("carried"), told.alias("object"))


def fragments(turns: DataFrame) -> DataFrame:
    """chat_id, pos, start, stop, actor, own (its object or null), state, intent, modality of every clause of
    turns (chat_id, pos, role, content)."""
    pieces = turns.select("chat_id", "pos", "role", F.posexplode(F.regexp_extract_all("content", F.lit(PIECE), F.lit(0))).alias("i", "piece"))
    before = W.partitionBy("chat_id", "pos").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
    clause = F.regexp_replace(F.regexp_replace("piece", "[.!?\\n]+$", ""), "^ +", "")
    rows = pieces.withColumn("start", offset + F.length(F.regexp_extract("piece", "^ *", 0))).withColumn("clause", clause).where("length(clause) > 0")
    c, piece, role = F.col("clause"), F.col("piece"), F.col("role")
    found = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))
    return rows.select(
        "chat_id",
        "pos",
        F.col("start").cast("long").alias("start"),
        (F.col("start") + F.length("clause")).cast("long").alias("stop"),
        F.coalesce(found(ACTOR), role).alias("actor"),
        found(OBJECT).alias("own"),
        F.when(c.rlike(DONE), "done").when(c.rlike(ONGOING), "ongoing").otherwise("unknown").alias("state"),
        F.when(piece.rlike("[?]"), "ask").when((role == "user") & c.rlike(PURPOSE), "request").when((role == "assistant") & c.rlike(ONGOING), "answer").otherwise("inform").alias("intent"),
        F.when(c.rlike(HEDGED), "hedged").when(piece.rlike("!"), "urgent").otherwise("stated").alias("modality"),
    )


@query(f"""WITH {FRAGMENTS}
SELECT own AS object, count(*) AS fragments, count(DISTINCT chat_id) AS chats, count(*) FILTER (state = 'done') AS done,
  arg_min(intent, (chat_id, pos, start)) AS first_intent, count(DISTINCT actor) AS actors
FROM f WHERE own IS NOT NULL GROUP BY own HAVING count(DISTINCT (chat_id, pos)) >= 2""")
def object_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that two turns or more name, with the states and intents of their fragments."""
    f = fragments(turn_messages(spark, sf_dir)).where("own IS NOT NULL")
    return (
        f.groupBy(F.col("own").alias("object"))
        .agg(
            F.count("*").alias("fragments"),
            F.countDistinct("chat_id").alias("chats"),
            F.count_if(F.col("state") == "done").alias("done"),
            F.min_by("intent", F.struct("chat_id", "pos", "start")).alias("first_intent"),
            F.countDistinct("actor").alias("actors"),
            F.countDistinct(F.struct("chat_id", "pos")).alias("turns"),
        )
        .where("turns >= 2")
        .drop("turns")
    )


HOST = "^https?://([^/?#]+)"


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '{HOST}', 1) AS own, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text,
  list_distinct(regexp_extract_all(html, 'href="https?://([^/?#"]+)', 1)) AS hosts FROM pages),
s AS (SELECT page_id, list_sort(list_filter(hosts, lambda h: h <> own)) AS outside, regexp_extract_all(text, '[^.!?\\n]+') AS clauses FROM p)
SELECT page_id, len(outside) AS n_outside, array_to_string(outside, ',') AS outside,
  len(list_filter(clauses, lambda c: regexp_matches(c, '{MEANS}'))) AS process,
  len(list_filter(clauses, lambda c: regexp_matches(c, '{BROKEN}'))) AS failure,
  len(list_filter(clauses, lambda c: regexp_matches(c, '{PURPOSE}'))) AS impact FROM s""")
def detail_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process, failure and impact clauses of a page, and the hosts outside its own that it points to."""
    html = F.col("html")
    hosts = F.array_distinct(F.regexp_extract_all(html, F.lit('href="https?://([^/?#"]+)'), F.lit(1)))
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.array_sort(F.filter(hosts, lambda h: h != F.regexp_extract("url", HOST, 1))).alias("outside"),
        F.regexp_extract_all(F.regexp_replace(html, "<[^>]*>", " "), F.lit("[^.!?\\n]+"), F.lit(0)).alias("clauses"),
    )
    count = lambda pattern: F.size(F.filter("clauses", lambda c: F.rlike(c, F.lit(pattern)))).cast("long")
    return rows.select(
        "page_id", F.size("outside").cast("long").alias("n_outside"), F.array_join("outside", ",").alias("outside"),
        count(MEANS).alias("process"), count(BROKEN).alias("failure"), count(PURPOSE).alias("impact"),
    )


@query(f"""WITH {M}, g AS (SELECT row_id, kind, k, us - lag(us) OVER w AS gap, lag(kind) OVER w AS before, lag(k) OVER w AS kb FROM m
  WINDOW w AS (PARTITION BY chat_id ORDER BY us, row_id)),
l AS (SELECT row_id, [before = 'view' AND kind = 'click' AND gap <= {6 * HOUR}, before = kind AND gap <= {12 * HOUR}, k // 10 = kb // 10, gap <= {2 * HOUR}] AS t, before FROM g)
SELECT row_id, CASE WHEN before IS NULL THEN 'first' WHEN t[1] THEN 'answer' WHEN t[2] THEN 'continuation' WHEN t[3] THEN 'same_topic' WHEN t[4] THEN 'nearby' ELSE 'distant' END AS label,
  len(list_filter(t, lambda x: x)) > 1 AS ambiguous FROM l""")
def context_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of a row to its neighbour before it; ambiguous where several fit."""
    w = W.partitionBy("chat_id").orderBy("us", "row_id")
    rows = event_messages(spark, sf_dir).select(
        "row_id", "kind", "k", (F.col("us") - F.lag("us").over(w)).alias("gap"), F.lag("kind").over(w).alias("before"), F.lag("k").over(w).alias("kb")
    )
    gap = F.col("gap")
    tests = {
        "answer": (F.col("before") == "view") & (F.col("kind") == "click") & (gap <= 6 * HOUR),
        "continuation": (F.col("before") == F.col("kind")) & (gap <= 12 * HOUR),
        "same_topic": F.floor(F.col("k") / 10) == F.floor(F.col("kb") / 10),
        "nearby": gap <= 2 * HOUR,
    }
    label, fits = F.when(F.col("before").isNull(), "first"), F.lit(0)
    for name, test in tests.items():
        label, fits = label.when(test, name), fits + F.coalesce(test.cast("int"), F.lit(0))
    return rows.select("row_id", label.otherwise("distant").alias("label"), (fits > 1).alias("ambiguous"))


@query(f"""WITH {M}, g AS (SELECT *, us - lag(us) OVER w AS gap, k // 10 <> lag(k) OVER w // 10 AS other, kind = lag(kind) OVER w OR k % 10 = lag(k) OVER w % 10 AS goes_on FROM m
  WINDOW w AS (PARTITION BY chat_id ORDER BY us, row_id)),
a AS (SELECT chat_id, CASE WHEN count(gap) >= 3 THEN greatest(4 * quantile_cont(gap, 0.5), 2 * quantile_cont(gap, 0.75)) ELSE {24 * HOUR} END AS cutoff FROM g GROUP BY chat_id),
b AS (SELECT g.*, CASE WHEN gap IS NULL THEN 'start' WHEN kind = 'signup' THEN 'explicit' WHEN other AND NOT goes_on AND gap > {6 * HOUR} THEN 'topic_shift'
  WHEN gap > cutoff AND NOT goes_on THEN 'silence' END AS reason FROM g JOIN a USING (chat_id)),
e AS (SELECT *, count(reason) OVER (PARTITION BY chat_id ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) AS episode FROM b)
SELECT chat_id, episode, count(*) AS n, min(us) AS start_us, max(us) AS end_us, arg_min(reason, (us, row_id)) AS reason FROM e GROUP BY chat_id, episode""")
def adaptive_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that end at an explicit boundary, at a topic shift, or at a silence over the chat's own
    cutoff; continuity holds an episode together across the latter two."""
    m = event_messages(spark, sf_dir)
    w = W.partitionBy("chat_id").orderBy("us", "row_id")
    before = F.lag("k").over(w)
    rows = m.select(
        "chat_id", "us", "row_id", "kind", (F.col("us") - F.lag("us").over(w)).alias("gap"), (F.floor(F.col("k") / 10) != F.floor(before / 10)).alias("other"),
        ((F.col("kind") == F.lag("kind").over(w)) | (F.col("k") % 10 == before % 10)).alias("goes_on"),
    )
    cutoffs = adaptive_cutoffs(m).select("chat_id", F.coalesce("cutoff_us", F.lit(24.0 * HOUR)).alias("cutoff"))
    gap, goes_on = F.col("gap"), F.col("goes_on")
    reason = F.when(gap.isNull(), "start").when(F.col("kind") == "signup", "explicit").when(F.col("other") & ~goes_on & (gap > 6 * HOUR), "topic_shift").when((gap > F.col("cutoff")) & ~goes_on, "silence")
    marked = rows.join(cutoffs, "chat_id").withColumn("reason", reason).withColumn("episode", F.count("reason").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("chat_id", "episode").agg(
        F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min_by("reason", F.struct("us", "row_id")).alias("reason")
    )


CARDS, LEADS, SALTS = 10, 15, 64


@query(f"""WITH {SCORED}, r AS (SELECT doc_id, lang, n_chars < 40 OR score < 28 AS low, row_number() OVER (PARTITION BY lang, n_chars < 40 OR score < 28 ORDER BY score DESC, n_chars DESC, doc_id) AS n FROM s)
SELECT doc_id, CASE WHEN low THEN 'low_information' WHEN n <= {CARDS} THEN 'card' WHEN n <= {CARDS + LEADS} THEN 'lead' ELSE 'dropped' END AS decision,
  CASE WHEN NOT low AND n <= {CARDS + LEADS} THEN n END AS place FROM r""")
def editorial_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten cards and fifteen leads a scope; every other candidate has its reason. Salted parts of a
    scope rank first and send on only what can still be a lead."""
    s = scored_documents(spark, sf_dir).select("doc_id", "lang", "n_chars", "score").withColumn("low", (F.col("n_chars") < 40) | (F.col("score") < 28))
    order = [F.desc("score"), F.desc("n_chars"), F.col("doc_id")]
    salted = s.where("NOT low").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = salted.withColumn("n", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
    top = salted.where(F.col("n") <= CARDS + LEADS).withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    decision = F.when(F.col("place") <= CARDS, "card").when(F.col("place") <= CARDS + LEADS, "lead").otherwise("dropped")
    chosen = top.select("doc_id", decision.alias("decision"), F.when(F.col("place") <= CARDS + LEADS, F.col("place")).alias("place"))
    nowhere = F.lit(None).cast("long").alias("place")
    rest = salted.where(F.col("n") > CARDS + LEADS).select("doc_id", F.lit("dropped").alias("decision"), nowhere)
    return chosen.unionByName(rest).unionByName(s.where("coalesce(low, true)").select("doc_id", F.lit("low_information").alias("decision"), nowhere))


@query("""WITH RECURSIVE w AS (SELECT page_id AS id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS family, list_filter(string_split_regex(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^\\p{L}0-9]+'), lambda x: x <> '') AS w FROM pages),
g AS (SELECT id, family, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(w[i:i + 1], ' '))) AS grams, row_number() OVER (PARTITION BY family ORDER BY id) AS i FROM w WHERE len(w) > 0),
r(family, i, kept) AS (SELECT DISTINCT family, 0::BIGINT, []::STRUCT(id BIGINT, grams VARCHAR[])[] FROM g
  UNION ALL SELECT r.family, g.i, CASE WHEN len(list_filter(r.kept, lambda k: 100 * len(list_intersect(k.grams, g.grams)) >= 50 * (len(k.grams) + len(g.grams) - len(list_intersect(k.grams, g.grams))))) > 0 THEN r.kept
    ELSE list_append(r.kept, {'id': g.id, 'grams': g.grams}) END FROM r JOIN g ON g.family = r.family AND g.i = r.i + 1),
z AS (SELECT family, list_transform(arg_max(kept, i), lambda k: k.id) AS ids FROM r GROUP BY family)
SELECT g.id, list_contains(z.ids, g.id) AS kept FROM g JOIN z USING (family)""")
def thinned_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages thinned within a language: one whose word bigrams are half those of an earlier
    kept title goes."""
    html = F.col("html")
    words = F.filter(F.split(F.lower(F.regexp_extract(html, "<title>([^<]*)</title>", 1)), "[^\\p{L}0-9]+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 2), " "))
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, 'lang="([a-z]+)"', 1).alias("family"), words.alias("w"))
    return thinned(rows.where(F.size("w") > 0).select(F.col("page_id").alias("id"), "family", F.array_distinct(pairs).alias("grams")), percent=50)


SPLIT_PAIRS = f"""{M}, p AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY us, row_id) AS pos FROM m),
h AS (SELECT a.row_id AS a, b.row_id AS b, a.kind <> b.kind AND b.us - a.us > {30 * HOUR} AS split FROM p a JOIN p b
  ON a.chat_id = b.chat_id AND b.pos > a.pos AND b.pos <= a.pos + 2 AND a.k % 5 = b.k % 5)"""


@query(f"""WITH RECURSIVE {SPLIT_PAIRS}, s AS (SELECT a AS x, b AS y FROM h WHERE NOT split UNION SELECT b, a FROM h WHERE NOT split),
r AS (SELECT x AS i, x AS c FROM s UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.i) SELECT i AS id, min(c) AS root FROM r GROUP BY i""")
def topic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates joined by all hinted pairs but those that carry a topic split."""
    x = neighbours(placed(event_messages(spark, sf_dir)).select("chat_id", "row_id", "us", "kind", "k", "pos"), 2)
    split = (F.col("a_kind") != F.col("b_kind")) & (F.col("b_us") - F.col("a_us") > 30 * HOUR)
    return components(x.where("a_k % 5 = b_k % 5").where(~split).select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b")))


def judge(pairs: list[tuple[str, str]]) -> list[str]:
    """A stand-in for a model: JSON by lengths, at times broken, with an unknown label, or citing what
    it was not given."""
    out = []
    for left, right in pairs:
        n, m = len(left), len(right)
        label = "same" if abs(n - m) < 60 else "related" if n < m else "maybe" if m % 11 == 0 else "different"
        cited = ["left", "right", "elsewhere"] if n % 13 == 0 else ["left"]
        out.append("not json {" if n % 17 == 0 else json.dumps({"label": label, "evidence": cited}))
    return out


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS n, lead(conv_id) OVER w AS conv2, lead(turn) OVER w AS turn2, lead(length(text)) OVER w AS m FROM conversations
  WINDOW w AS (PARTITION BY conv_id // 2 ORDER BY conv_id, turn)),
j AS (SELECT *, CASE WHEN abs(n - m) < 60 THEN 'same' WHEN n < m THEN 'related' WHEN m % 11 = 0 THEN 'maybe' ELSE 'different' END AS label FROM t WHERE conv2 IS NOT NULL)
SELECT conv_id AS left_chat, turn AS left_pos, conv2 AS right_chat, turn2 AS right_pos,
  CASE WHEN conv_id <> conv2 THEN 'cross_chat' WHEN n % 17 = 0 THEN 'no_json' WHEN label = 'maybe' THEN 'label' WHEN n % 13 = 0 THEN 'evidence' ELSE 'accepted' END AS outcome,
  CASE WHEN conv_id = conv2 AND n % 17 <> 0 AND label <> 'maybe' AND n % 13 <> 0 THEN label END AS label FROM j""")
def pairwise_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns judged by an injected callable; its answers are checked: one chat, JSON, a known
    label, evidence out of what was given. Pairs across chats are refused before they are asked."""
    w = W.partitionBy(F.floor(F.col("chat_id") / 2)).orderBy("chat_id", "pos")
    t = turn_messages(spark, sf_dir).select(
        F.col("chat_id").alias("left_chat"), F.col("pos").alias("left_pos"), F.lead("chat_id").over(w).alias("right_chat"), F.lead("pos").over(w).alias("right_pos"),
        F.col("content").alias("left"), F.lead("content").over(w).alias("right"),
    ).where("right_chat IS NOT NULL")
    keys = ["left_chat", "left_pos", "right_chat", "right_pos"]
    asked = apply_pair_model(t.where("left_chat = right_chat"), keys, judge).withColumn("j", F.from_json("answer", "label string, evidence array<string>"))
    known = F.array(F.lit("left"), F.lit("right"))
    outcome = (
        F.when(F.col("j.evidence").isNull(), "no_json").when(~F.coalesce(F.col("j.label").isin("same", "related", "different"), F.lit(False)), "label")
        .when(F.size(F.array_except("j.evidence", known)) > 0, "evidence").otherwise("accepted")
    )
    judged = asked.withColumn("outcome", outcome).select(*keys, "outcome", F.when(F.col("outcome") == "accepted", F.col("j.label")).alias("label"))
    refused = t.where("left_chat <> right_chat").select(*keys, F.lit("cross_chat").alias("outcome"), F.lit(None).cast("string").alias("label"))
    return judged.unionByName(refused)


@query("""WITH b AS (SELECT o_orderkey AS bundle, o_custkey AS chat, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 1 END AS version, o_orderstatus AS status,
  list(l_linenumber) FILTER (l_linenumber IS NOT NULL) AS ids, count(*) FILTER (l_suppkey % 37 = 0) AS foreign_ids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT bundle, CASE WHEN version <> 1 THEN 'version' WHEN status NOT IN ('F', 'O') THEN 'status' WHEN ids IS NULL THEN 'no_messages'
  WHEN len(ids) <> len(list_distinct(ids)) THEN 'repeated' WHEN foreign_ids > 0 THEN 'outside_chat' ELSE 'ok' END AS verdict,
  coalesce(array_to_string(list_sort(list_distinct(ids)), ','), '') AS messages FROM b""")
def bundle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles as they arrive, normalised to sorted distinct messages and checked against a fixed
    schema, their evidence and the boundary of their chat; the first rule that fails is named."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle"), F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(1).alias("version"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bundle"))
    l = lines.agg(F.count("l_linenumber").alias("n"), F.array_sort(F.collect_set("l_linenumber")).alias("ids"), F.count_if(F.col("l_suppkey") % 37 == 0).alias("foreign_ids"))  # noqa: E741
    verdict = (
        F.when(F.col("version") != 1, "version").when(~F.col("status").isin("F", "O"), "status").when(F.coalesce("n", F.lit(0)) == 0, "no_messages")
        .when(F.col("n") != F.size("ids"), "repeated").when(F.col("foreign_ids") > 0, "outside_chat").otherwise("ok")
    )
    return o.join(l, "bundle", "left").select("bundle", verdict.alias("verdict"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("messages"))


@query(_session_sql(720) + """, c AS (SELECT chat_id, session, kind, count(*) AS n FROM i GROUP BY ALL),
b AS (SELECT chat_id, session, sum(n)::BIGINT AS n, count(*) AS kinds, string_agg(n || ' ' || kind, ', ' ORDER BY n DESC, kind) AS told FROM c GROUP BY chat_id, session)
SELECT chat_id, session, 'Chat ' || chat_id || ': ' || n || CASE WHEN n = 1 THEN ' message' ELSE ' messages' END || ' (' || told || ')'
  || CASE WHEN kinds = 1 THEN ', all alike.' ELSE '.' END AS summary FROM b WHERE n >= 2""")
def block_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A readable sentence for every block of two messages or more."""
    c = gap_sessions(event_messages(spark, sf_dir), 720).groupBy("chat_id", "session", "kind").agg(F.count("*").alias("n"))
    b = c.groupBy("chat_id", "session").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "kind"))).alias("told")).where("n >= 2")
    told = F.array_join(F.transform("told", lambda x: F.concat((-x["less"]).cast("string"), F.lit(" "), x["kind"])), ", ")
    sentence = F.concat(F.lit("Chat "), F.col("chat_id"), F.lit(": "), F.col("n"), F.when(F.col("n") == 1, " message").otherwise(" messages"), F.lit(" ("), told, F.lit(")"))
    return b.select("chat_id", "session", F.concat(sentence, F.when(F.col("kinds") == 1, ", all alike.").otherwise(".")).alias("summary"))


def invariant_counts(turns: DataFrame, clauses: DataFrame, episodes: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """invariant, violations: clauses (chat_id, pos, start, stop, own) of turns, episodes (chat_id, episode, n,
    start_us, end_us) of rows, and groups (id, root)."""
    by_turn = W.partitionBy("chat_id", "pos").orderBy("start")
    overlap = clauses.withColumn("free", F.lag("stop").over(by_turn)).agg(F.count_if(F.col("start") < F.col("free")))
    there = clauses.join(turns.select("chat_id", "pos", "content"), ["chat_id", "pos"], "left")
    span = F.substring(F.col("content"), F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    outside = there.agg(F.count_if(F.col("content").isNull() | (F.col("stop") > F.length("content"))))
    unnamed = there.where("own IS NOT NULL").agg(F.count_if(~F.contains(span, F.col("own"))))
    held = episodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    lost = held.crossJoin(rows.agg(F.count("*").alias("rows"))).select(F.abs(F.col("n") - F.col("rows")))  # two single rows
    follow = W.partitionBy("chat_id").orderBy("episode")
    crossed = episodes.withColumn("ended", F.lag("end_us").over(follow)).agg(F.count_if(F.col("start_us") < F.col("ended")))
    wrong = groups.groupBy("root").agg(F.min("id").alias("least")).agg(F.count_if(F.col("least") != F.col("root")))
    found = {"clause_spans_overlap": overlap, "episode_rows_lost": lost, "episodes_overlap": crossed, "fragment_outside_turn": outside, "object_not_in_clause": unnamed, "root_not_smallest": wrong}
    parts = [one.select(F.lit(name).alias("invariant"), F.col(one.columns[0]).cast("long").alias("violations")) for name, one in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH f AS ({ORACLES["context_fragments"]}), e AS ({ORACLES["adaptive_episodes"]}), c AS ({ORACLES["topic_components"]}),
t AS (SELECT f.*, v.text, v.conv_id FROM f LEFT JOIN conversations v ON v.conv_id = f.chat_id AND v.turn = f.pos)
SELECT 'clause_spans_overlap' AS invariant, count(*)::BIGINT AS violations FROM (SELECT start, lag(stop) OVER (PARTITION BY chat_id, pos ORDER BY start) AS free FROM f) WHERE start < free
UNION ALL SELECT 'episode_rows_lost', abs((SELECT coalesce(sum(n), 0) FROM e) - (SELECT count(*) FROM events))::BIGINT
UNION ALL SELECT 'episodes_overlap', count(*) FROM (SELECT start_us, lag(end_us) OVER (PARTITION BY chat_id ORDER BY episode) AS ended FROM e) WHERE start_us < ended
UNION ALL SELECT 'fragment_outside_turn', count(*) FROM t WHERE text IS NULL OR stop > length(text)
UNION ALL SELECT 'object_not_in_clause', count(*) FROM t WHERE object IS NOT NULL AND NOT carried AND NOT contains(substr(text, start + 1, stop - start), object)
UNION ALL SELECT 'root_not_smallest', count(*) FROM (SELECT root, min(id) AS least FROM c GROUP BY root) WHERE least <> root""")
def pipeline_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-tolerance counts over what the queries make: spans of clauses, episodes and components."""
    turns = turn_messages(spark, sf_dir)
    return invariant_counts(turns, fragments(turns), adaptive_episodes(spark, sf_dir), event_messages(spark, sf_dir), topic_components(spark, sf_dir))


MAX_RETRIES = 3


@query(f"""WITH t AS (SELECT o_orderkey AS task_id, epoch_us(o_orderdate) AS at_us, o_orderkey % 6 AS failures FROM orders),
a AS (SELECT *, unnest(range(1, least(failures, {MAX_RETRIES}) + 2)) AS attempt FROM t)
SELECT task_id, attempt, (at_us + 1000000 * CASE attempt WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 7 END)::BIGINT AS at_us,
  CASE WHEN attempt > failures THEN 'succeeded' WHEN attempt = {MAX_RETRIES + 1} THEN 'failed' ELSE 'retried' END AS outcome FROM a""")
def worker_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a queue's tasks: at most one more than the retries, after waits that double from one
    second up to five."""
    k = F.col("o_orderkey") % 6  # how often a task fails
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), micros("o_orderdate").alias("at_us"), k.alias("failures"))
    rows = tasks.withColumn("attempt", F.explode(F.sequence(F.lit(1).cast("long"), F.least("failures", F.lit(MAX_RETRIES)) + 1)))
    waits = F.transform(F.sequence(F.lit(0).cast("long"), F.col("attempt") - 1), lambda i: F.when(i == 0, 0).otherwise(F.least(F.pow(F.lit(2.0), i - 1), F.lit(5.0))).cast("long"))
    waited = F.aggregate(waits, F.lit(0).cast("long"), lambda a, x: a + x)
    outcome = F.when(F.col("attempt") > F.col("failures"), "succeeded").when(F.col("attempt") == MAX_RETRIES + 1, "failed").otherwise("retried")
    return rows.select("task_id", "attempt", (F.col("at_us") + 1_000_000 * waited).alias("at_us"), outcome.alias("outcome"))


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


@query(f"""WITH {M}, q AS (SELECT row_id AS job_id, us AS asked_us, k % 20 + 1 AS days, lag(us) OVER (ORDER BY us, row_id) AS before FROM m WHERE kind = 'signup'),
j AS (SELECT job_id, asked_us, asked_us - days * {24 * HOUR} AS start_us, before IS NOT NULL AND asked_us - before < {HOUR} AS busy FROM q),
d AS (SELECT (us // {24 * HOUR})::BIGINT AS day, count(*) AS n FROM m GROUP BY 1)
SELECT job_id, CASE WHEN busy THEN 'refused' ELSE 'done' END AS status, CASE WHEN NOT busy THEN coalesce((SELECT sum(n) FROM d WHERE day >= start_us // {24 * HOUR} AND day < asked_us // {24 * HOUR}), 0)::BIGINT END AS scanned FROM j""")
def backfill_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A durable row for every requested backfill of whole days: refused while another one ran in the
    hour before, else the messages of its range, from a running sum by day."""
    m = event_messages(spark, sf_dir)
    day = F.floor(F.col("us") / (24 * HOUR))
    # Days are as few as the archive is long; jobs are a day's worth each, so neither window is large.
    days = m.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    sums = days.withColumn("upto", F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))).select("day", "upto")
    jobs = m.where("kind = 'signup'").select(F.col("row_id").alias("job_id"), "us", (F.col("k") % 20 + 1).alias("days"), day.alias("day"))
    by_day = W.partitionBy("day").orderBy("us", "job_id")
    # The last request of the day before stands in for a first one's predecessor.
    last = jobs.groupBy((F.col("day") + 1).alias("day")).agg(F.max("us").alias("eve"))
    jobs = jobs.join(last, "day", "left").withColumn("before", F.coalesce(F.lag("us").over(by_day), F.col("eve")))
    jobs = jobs.withColumn("busy", F.coalesce(F.col("us") - F.col("before") < HOUR, F.lit(False)))
    ends = jobs.select("job_id", "busy", F.explode(F.array(F.struct(F.lit(1).alias("sign"), (F.col("day") - 1).alias("day")), F.struct(F.lit(-1).alias("sign"), (F.col("day") - F.col("days") - 1).alias("day")))).alias("e"))
    ends = ends.select("job_id", "busy", F.col("e.sign").alias("sign"), F.col("e.day").alias("at"))
    marks = sums.withColumn("until", F.lead("day").over(W.orderBy("day")))
    covered = marks.select("upto", F.explode(F.sequence("day", F.coalesce(F.col("until") - 1, F.col("day") + 40))).alias("at"))
    out = ends.join(covered, "at", "left").groupBy("job_id", "busy").agg(F.sum(F.col("sign") * F.coalesce("upto", F.lit(0))).alias("scanned"))
    return out.select("job_id", F.when(F.col("busy"), "refused").otherwise("done").alias("status"), F.when(~F.col("busy"), F.col("scanned")).alias("scanned"))
