"""Clauses by the classes of a profile: what they do and how sure they are, and what stands in which role.

A text is split once into clauses and words, and the profile's table is joined to the words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import profiles
from parley.plans.registry import query
from parley.plans.semantics import CLAIM_WORDS, ENTRIES
from parley.sources.tables import table

ROLES = ("purpose", "means", "place")
STATES = {"deny": "denied", "request": "wanted", "plan": "planned", "ask": "open", "report": "told"}
#: What holds sentence marks goes before clauses are split.
VALUES = ("[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){1,8}", "[0-9]{1,3}(?:\\.[0-9]{1,3}){3}", "[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2})?|[0-9]{1,2}:[0-9]{2}",
          "[0-9]+(?:[.,][0-9]+)? ?(?:%|kg|km|GB|MB|ms|EUR|USD)", "[0-9]{3,}")
CONTENT = "^\\p{L}{4,}$"


def clause_words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, clause, i, word (lower case), class, content: the words of every clause with their class, if they have one."""
    clean: Column = F.col(text)
    for pattern in VALUES:
        clean = F.regexp_replace(clean, pattern, " § ")
    parts = rows.select(key, F.posexplode(F.split(clean, "[.!?\\n]+")).alias("clause", "part"))
    words = parts.select(key, "clause", F.posexplode(F.regexp_extract_all("part", F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))).alias("i", "word")).withColumn("word", F.lower("word"))
    known = F.broadcast(rows.sparkSession.createDataFrame(ENTRIES, "word string, class string"))  # some hundred words
    return words.join(known, "word", "left").withColumn("content", F.col("class").isNull() & F.col("word").rlike(CONTENT))


def clauses(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, clause, words: the clauses of every text that have words, in lower case. Words stay in their clause, so a
    row a clause is what travels."""
    clean: Column = F.col(text)
    for pattern in VALUES:
        clean = F.regexp_replace(clean, pattern, " § ")
    # The outer form: for the plain one Spark infers a filter that would split the text anew.
    parts = rows.select(key, F.posexplode_outer(F.split(clean, "[.!?\\n]+")).alias("clause", "part")).where("part IS NOT NULL")
    words = F.transform(F.regexp_extract_all("part", F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), F.lower)
    return parts.select(key, "clause", words.alias("words")).where("size(words) > 0")


def class_of(word: Column) -> Column:
    """The class of a word in the profile, by a set for each class; a profile has some hundred words."""
    by: dict[str, list[str]] = {}
    for w, name in ENTRIES:
        by.setdefault(name, []).append(w)
    return F.coalesce(*[F.when(word.isin(words), name) for name, words in by.items()])


SQL_WORDS = CLAIM_WORDS.partition(",\nn AS (")[0] + ", b AS (SELECT doc_id, clause, i, lower(word) AS word, class, class IS NULL AND regexp_matches(lower(word), '^\\p{L}{4,}$') AS content FROM l)"
SQL_ROLES = ", ".join(f"'{r}'" for r in ROLES)


@query(f"""WITH {SQL_WORDS}, x AS (SELECT doc_id, clause, class, i, first_value(CASE WHEN content THEN word END IGNORE NULLS) OVER (PARTITION BY doc_id, clause ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS entity FROM b)
SELECT doc_id, clause, class AS role, entity, count(*) AS n FROM x WHERE class IN ({SQL_ROLES}) AND entity IS NOT NULL GROUP BY ALL""")
def profiled_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by role: the next content word of the clause after a word of purpose, means or place."""
    # A clause as a text of its role and content words; what stands between two content words plays its roles for the second.
    known = clauses(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("classes", F.transform("words", class_of))
    token = lambda w, c: F.when(c.isin(*ROLES), F.concat(c, F.lit(" "))).when(c.isNull() & w.rlike(CONTENT), F.concat(F.lit("|"), w, F.lit(" ")))
    pieces = known.select("doc_id", "clause", F.split(F.array_join(F.zip_with("words", "classes", token), ""), "[|]").alias("pieces"))
    roles = lambda p, i: F.when(i == 0, p).otherwise(F.substr(p, F.instr(p, F.lit(" ")) + 1))
    met = F.transform("pieces", lambda p, i: F.struct(F.trim(roles(p, i)).alias("roles"), F.substring_index(F.get("pieces", i + 1), " ", 1).alias("entity")))
    # Only what plays a role becomes a row, without the rest of its clause.
    found = pieces.select("doc_id", "clause", F.filter(met, lambda x: (x["roles"] != "") & x["entity"].isNotNull()).alias("met"))
    rows = found.select("doc_id", "clause", F.explode_outer("met").alias("x")).where("x IS NOT NULL").select("doc_id", "clause", F.split("x.roles", " ").alias("roles"), "x.entity")
    return rows.select("doc_id", "clause", F.explode_outer("roles").alias("role"), "entity").groupBy("doc_id", "clause", "role", "entity").agg(F.count("*").alias("n"))


SQL_RANK = "CASE class " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(profiles.ACTIONS)) + " END"
SQL_STATE = "CASE rank " + " ".join(f"WHEN {i} THEN '{STATES[a]}'" for i, a in enumerate(profiles.ACTIONS)) + " ELSE 'unknown' END"


@query(f"""WITH {SQL_WORDS}, f AS (SELECT doc_id, clause, count(*) AS words, min({SQL_RANK}) AS rank, bool_or(coalesce(class = 'hedge', false)) AS hedged, bool_or(coalesce(class = 'deny', false)) AS denied,
  arg_max(word, (length(word), -i)) FILTER (content) AS object, count(*) FILTER (class IN ({SQL_ROLES})) AS roles FROM b GROUP BY doc_id, clause)
SELECT doc_id, clause, words, {SQL_STATE} AS state, hedged, denied, object, roles FROM f""")
def profiled_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with their state by the strongest class of action, whether they hedge or deny, and their object, the longest
    content word."""
    known = clauses(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("classes", F.transform("words", class_of))
    has = lambda name: F.array_contains(F.array_compact("classes"), name)
    rank = F.coalesce(*[F.when(has(a), i) for i, a in enumerate(profiles.ACTIONS)])
    content = F.array_compact(F.transform("words", lambda w, i: F.when(F.get("classes", i).isNull() & w.rlike(CONTENT), F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("word")))))
    own = known.select("doc_id", "clause", F.size("words").cast("long").alias("words"), rank.alias("rank"), has("hedge").alias("hedged"), has("deny").alias("denied"), F.array_max(content).alias("longest"), F.size(F.filter("classes", lambda c: c.isin(*ROLES))).cast("long").alias("roles"))
    # Rows of a document that stands twice are one.
    c = own.groupBy("doc_id", "clause").agg(F.sum("words").alias("words"), F.min("rank").alias("rank"), F.bool_or("hedged").alias("hedged"), F.bool_or("denied").alias("denied"), F.max("longest")["word"].alias("object"), F.sum("roles").alias("roles"))
    state = F.coalesce(F.get(F.array(*[F.lit(STATES[a]) for a in profiles.ACTIONS]), F.col("rank")), F.lit("unknown"))
    return c.select("doc_id", "clause", "words", state.alias("state"), "hedged", "denied", "object", "roles")
