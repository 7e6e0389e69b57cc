"""Event proposals with their quality, and event briefs, over the documents as items of chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import events
from parley.operators.graph import checkpointed
from parley.plans.analytics import MINUTE, SCORED
from parley.plans.analytics import P as PROFILE
from parley.plans.registry import query
from parley.sources.tables import table

#: A document stands for an item every 20 minutes.
STEP = 20 * MINUTE
DOMAINS = {"legal": "(?i)licen[sc]e", "mail": "@", "network": "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "table": "[|]"}
TOPICS = {name: pattern for name, (pattern, _) in PROFILE.weights.items() if name in ("action", "risk", "trade", "question")}
RULES = events.EventRules(weak_topics=("question",))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chat, person, us, points, telling, private, asking, terms, domains, topics of every document."""
    t = F.coalesce("text", F.lit(""))
    # Each class is looked for once, for the score as well.
    classes = {name: pattern for name, (pattern, _) in PROFILE.weights.items()} | DOMAINS
    met = F.array_compact(F.array(*[F.when(F.col("t").rlike(p), k) for k, p in sorted(classes.items())]))
    d = table(spark, sf_dir, "documents").withColumn("t", t).withColumn("met", met)
    tags = F.filter("met", lambda x: x.isin(*TOPICS, *DOMAINS))
    domains = F.filter(tags, lambda x: x.isin(*DOMAINS))
    telling = F.exists(tags, lambda x: x.isin("action", "risk", "trade"))
    points = T.message_score(F.col("t"), PROFILE, F.col("met")) + F.least(F.lit(20), F.floor(F.length("t") / 12)) + F.when(F.size(domains) > 0, 20).otherwise(0)
    return d.select(
        F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("chat"), F.coalesce("lang", F.lit("")).alias("person"), (F.col("doc_id") * STEP).alias("us"), points.cast("long").alias("points"), telling.alias("telling"),
        F.coalesce(F.col("source").endswith("0"), F.lit(False)).alias("private"), F.array_contains(tags, "question").alias("asking"), T.terms(F.col("t"), 11).alias("terms"), domains.alias("domains"), tags.alias("topics"),
    )


def _list(names: dict[str, str]) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in sorted(names.items()))
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


ITEMS = f"""{SCORED.replace("FROM documents", "FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)")},
g AS (SELECT *, {_list(DOMAINS)} AS domains, {_list(TOPICS | DOMAINS)} AS topics, list_distinct(regexp_extract_all(lower(text), '[a-z]{{11,}}')) AS terms FROM s),
i AS (SELECT doc_id AS id, coalesce(source, '') AS chat, doc_id * {STEP} AS us, score + least(20, length(text) // 12) + CASE WHEN len(domains) > 0 THEN 20 ELSE 0 END AS points,
  list_has_any(topics, ['action', 'risk', 'trade']) AS telling, coalesce(lang, '') AS person, coalesce(suffix(source, '0'), false) AS private, list_contains(topics, 'question') AS asking,
  terms, domains, topics FROM g)"""

#: The clauses of ``proposals``, one after the other.
PROPOSALS = f"""{ITEMS}, t AS (SELECT *, unnest(terms) AS term FROM i),
k AS (SELECT t.*, CASE WHEN (SELECT len(list_distinct(flatten(list(u.domains)))) FROM t u WHERE u.term = t.term) <= 1 THEN 'one' ELSE array_to_string(domains, ',') END AS lane FROM t),
c AS (SELECT term, lane, list_sort(list(id)) AS members, count(*) AS n, count(DISTINCT chat) AS chats, max(points) AS points, list(terms) AS sets, list(topics) AS all_topics, list(domains) AS all_domains
  FROM k GROUP BY term, lane HAVING count(*) BETWEEN 2 AND (SELECT greatest(8, least(24, round(0.08 * count(*)))) FROM documents)
  AND max(us) - min(us) <= {RULES.span_us} AND count(*) FILTER (telling) >= 2 AND (max(points) >= {RULES.least_points} OR (count(DISTINCT chat) >= 2 AND count(*) >= 3))),
q AS (SELECT term, members, n, chats, points, len(list_reduce(sets, lambda a, b: list_intersect(a, b))) AS specific,
  list_sort(list_filter(list_reduce(all_topics, lambda a, b: list_intersect(a, b)), lambda x: x <> 'question')) AS topics,
  list_distinct(flatten(all_domains)) AS any_domain, list_reduce(all_domains, lambda a, b: list_intersect(a, b)) AS every_domain FROM c),
v AS (SELECT *, len(any_domain) <= 1 OR len(any_domain) = len(every_domain) AS fits, len(topics) > 0 AS shared, chats >= 2 AS crossing FROM q),
w AS (SELECT *, fits AND (n <= 1 OR NOT crossing OR shared OR specific >= 2) AS supported FROM v)"""


QUALITY = """greatest(0, least(100, 25 + least(24, 6 * n) + least(18, 7 * chats) + least(18, 7 * specific) + 15 * shared::INT + 8 * crossing::INT - 18 * (crossing AND NOT supported)::INT - 45 * (NOT fits)::INT))::BIGINT AS score,
greatest(20, least(95, 38 + least(22, 6 * n) + least(15, 6 * chats) + least(16, 6 * specific) + 12 * shared::INT - 20 * (crossing AND NOT supported)::INT - 35 * (NOT fits)::INT))::BIGINT AS confidence"""


@query(f"""WITH {PROPOSALS} SELECT term, array_to_string(members, ',') AS members, n, chats, points, specific, array_to_string(topics, ',') AS topics,
{QUALITY} FROM w WHERE chats < 2 OR supported""")
def event_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items around terms that few share, near in time and of one domain, with the quality of each cluster."""
    every = checkpointed(items(spark, sf_dir))  # texts are scored once
    found = events.proposals(every, RULES, events.most_anchored(every.count()))
    return found.select("term", F.array_join("members", ",").alias("members"), "n", "chats", "points", "specific", F.array_join("topics", ",").alias("topics"), "score", "confidence")


#: Proposals in order, and a fold over them that carries the groups so far.
MERGED = f"""{PROPOSALS}, o AS (SELECT row_number() OVER (ORDER BY chats DESC, points DESC, n DESC, length(term) DESC, term DESC, members DESC) AS k, members, topics, any_domain, every_domain
  FROM w WHERE chats < 2 OR supported),
r(k, groups) AS (
  SELECT 0::BIGINT, []::STRUCT(members BIGINT[], topics VARCHAR[], any_domain VARCHAR[], every_domain VARCHAR[])[]
  UNION ALL
  SELECT x.k, CASE
    WHEN x.home IS NOT NULL THEN list_transform(x.groups, lambda g, j: CASE WHEN j = x.home THEN {{'members': list_distinct(g.members || x.members), 'topics': list_intersect(g.topics, x.topics),
      'any_domain': list_distinct(g.any_domain || x.any_domain), 'every_domain': list_intersect(g.every_domain, x.every_domain)}} ELSE g END)
    WHEN x.repeats THEN x.groups ELSE list_append(x.groups, {{'members': x.members, 'topics': x.topics, 'any_domain': x.any_domain, 'every_domain': x.every_domain}}) END
  FROM (SELECT o.*, r.groups,
    list_position(list_transform(r.groups, lambda g: 100 * len(list_intersect(g.members, o.members)) >= {RULES.join_percent} * least(len(g.members), len(o.members)) AND list_has_any(g.topics, o.topics)
      AND (len(list_distinct(g.any_domain || o.any_domain)) <= 1 OR len(list_distinct(g.any_domain || o.any_domain)) = len(list_intersect(g.every_domain, o.every_domain)))), true) AS home,
    len(list_filter(r.groups, lambda g: 100 * len(list_intersect(g.members, o.members)) >= {RULES.drop_percent} * least(len(g.members), len(o.members)))) > 0 AS repeats
    FROM r JOIN o ON o.k = r.k + 1) x),
m AS (SELECT event, unnest(g.members) AS id FROM (SELECT unnest(groups) AS g, generate_subscripts(groups, 1) AS event FROM r WHERE k = (SELECT count(*) FROM o)))"""


@query(f"""WITH RECURSIVE {MERGED},
b AS (SELECT m.event, i.* FROM m JOIN i USING (id) UNION ALL SELECT -1 - id, i.* FROM i
  WHERE id NOT IN (SELECT id FROM m) AND (points >= {RULES.single_points} OR (points >= {RULES.single_points_with_domain} AND len(domains) > 0) OR (private AND asking))),
z AS (SELECT event, list_sort(list(id)) AS members, count(*) AS n, count(DISTINCT chat) AS chats, count(DISTINCT person) AS people, max(points) AS points, count(*) FILTER (points >= {RULES.least_points}) AS substantive,
  bool_or(private OR asking) AS for_me, min(us) AS start_us, max(us) AS end_us, list_reduce(list(terms), lambda a, b: list_intersect(a, b)) AS common_terms, len(list_distinct(flatten(list(terms)))) AS any_terms,
  list_sort(list_filter(list_reduce(list(topics), lambda a, b: list_intersect(a, b)), lambda x: x <> 'question')) AS topics,
  list_sort(list_distinct(flatten(list(domains)))) AS domains, list_reduce(list(domains), lambda a, b: list_intersect(a, b)) AS every_domain FROM b GROUP BY event),
e AS (SELECT *, CASE WHEN len(common_terms) > 0 THEN len(common_terms) ELSE any_terms END AS specific, len(domains) <= 1 OR len(domains) = len(every_domain) AS fits, len(topics) > 0 AS shared, chats >= 2 AS crossing FROM z
  WHERE CASE WHEN chats >= 2 THEN substantive >= 2 OR chats >= 3 ELSE n < 2 OR substantive >= 2 END),
y AS (SELECT *, fits AND (n <= 1 OR NOT crossing OR shared OR specific >= 2) AS supported FROM e)
SELECT substr(sha256(array_to_string(members, '|')), 1, 14) AS event_id, members[1] AS lead, n, chats, people, CASE WHEN for_me THEN 'for_me' WHEN chats >= 2 OR people >= 3 THEN 'trending' ELSE 'pending' END AS lane,
  CASE WHEN n >= 3 AND (chats >= 2 OR people >= 2) THEN 'ongoing' ELSE 'pending' END AS status, least(100, points + least(30, 5 * n) + least(25, 5 * greatest(0, chats - 1)))::BIGINT AS importance,
  {QUALITY}, specific, array_to_string(topics, ',') AS topics, array_to_string(domains, ',') AS domains, start_us, end_us
FROM y WHERE fits AND (chats < 2 OR supported)""")
def event_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of proposals merged in order, and telling items outside of them, each with lane, status and points."""
    every = checkpointed(items(spark, sf_dir))  # texts are scored once
    members = events.events(events.proposals(every, RULES, events.most_anchored(every.count())), RULES)
    return events.briefs(every, members, RULES)
