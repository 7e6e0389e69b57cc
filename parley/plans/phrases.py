"""Phrases that the chats of the conversations repeat, with reactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import phrases
from parley.plans.analytics import MINUTE
from parley.plans.registry import query
from parley.sources.tables import table

#: Conversations are strands of this many chats, a strand every ten minutes, a turn a minute.
CHATS = 5
SHORT = 60
LOW, HIGH = 4, 8

MESSAGES = f"""m AS (SELECT conv_id % {CHATS} AS chat, conv_id * 1000 + turn AS id, (conv_id * 10 + turn) * {MINUTE} AS us, role AS person, length(text) < {SHORT} AS reaction,
  regexp_matches(text, '[?]|@') AS operational, regexp_extract_all(lower(text), '[^\\s.,!?]+') AS words FROM conversations WHERE text IS NOT NULL)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(
        (F.col("conv_id") % CHATS).alias("chat"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), ((F.col("conv_id") * 10 + F.col("turn")) * MINUTE).alias("us"), F.col("role").alias("person"),
        (F.length(t) < SHORT).alias("reaction"), t.rlike("[?]|@").alias("operational"), F.regexp_extract_all(F.lower(t), F.lit(r"[^\s.,!?]+"), F.lit(0)).alias("words"),
    )


GRAMS = f"""{MESSAGES}, g AS (SELECT DISTINCT chat, id, us, person, operational, k, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM (SELECT *, unnest(range({LOW}, {HIGH} + 1)) AS k FROM m WHERE NOT reaction)))"""
CANDIDATES = f"""{GRAMS}, u AS (SELECT chat, gram, k, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2),
x AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.chat = u.chat AND v.n = u.n AND v.k > u.k AND contains(' ' || v.gram || ' ', ' ' || u.gram || ' '))),
h AS (SELECT r.chat, r.id, (SELECT max_by(t.id, (t.us, t.id)) FROM m t WHERE t.chat = r.chat AND NOT t.reaction AND (t.us, t.id) < (r.us, r.id) AND r.us - t.us <= {5 * MINUTE}) AS target FROM m r WHERE r.reaction),
f AS (SELECT chat, target AS id, count(*) AS reactions FROM h GROUP BY ALL),
c AS (SELECT x.chat, x.gram, count(*) AS n, count(DISTINCT person) AS people, coalesce(sum(reactions), 0)::BIGINT AS reactions, bool_or(operational) AS operational, min(us) AS first_us, max(us) - min(us) AS span
  FROM x JOIN g USING (chat, gram) LEFT JOIN f USING (chat, id) GROUP BY ALL),
p AS (SELECT chat, gram, n, people, reactions, CASE WHEN reactions < 2 THEN 'repeated_phrase' ELSE 'inside_joke' END AS kind,
  least(94, 42 + least(18, 8 * (n - 2)) + CASE WHEN people >= 2 THEN 14 ELSE 0 END + least(28, 10 * reactions) + CASE WHEN span <= {15 * MINUTE} THEN 8 WHEN span <= {120 * MINUTE} THEN 4 ELSE 0 END)::BIGINT AS confidence, first_us
  FROM c WHERE NOT (operational AND reactions < 2) AND NOT (reactions < 2 AND n < 3) AND NOT (reactions < 2 AND people < 2))"""


@query(f"""WITH {GRAMS}, u AS (SELECT chat, gram, k, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2)
SELECT chat, gram, n FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.chat = u.chat AND v.n = u.n AND v.k > u.k AND contains(' ' || v.gram || ' ', ' ' || u.gram || ' '))""")
def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four to eight words that two messages of a chat or more use, the longest of equal support."""
    return phrases.repeated_phrases(messages(spark, sf_dir).where("NOT reaction"), LOW, HIGH, 2)


@query(f"""WITH RECURSIVE {CANDIDATES}, o AS (SELECT *, row_number() OVER (ORDER BY chat, confidence DESC, n DESC, length(gram) DESC, gram) AS i FROM p WHERE confidence >= 55),
r(i, kept) AS (SELECT 0::BIGINT, []::STRUCT(chat BIGINT, gram VARCHAR)[] UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(r.kept, lambda k: k.chat = o.chat AND (contains(k.gram, ' ' || o.gram || ' ') OR contains(' ' || o.gram || ' ', k.gram)))) > 0 THEN r.kept
    ELSE list_append(r.kept, {{'chat': o.chat, 'gram': ' ' || o.gram || ' '}}) END FROM r JOIN o ON o.i = r.i + 1),
z AS (SELECT kept FROM r WHERE i = (SELECT count(*) FROM o))
SELECT chat, gram, n, people, reactions, kind, confidence, first_us FROM o, z WHERE list_contains(kept, {{'chat': chat, 'gram': ' ' || gram || ' '}})""")
def meme_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of a chat that may be a joke: repeated by several people or met with reactions; of two where one
    holds the other, the surer one."""
    return phrases.without_repeats(phrases.phrase_candidates(messages(spark, sf_dir), LOW, HIGH, 5 * MINUTE, MINUTE), LOW)
