"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions
only.

Training tokens are stored once as positional postings, partitioned by document: a row holds the
tokens of a document in the order of their positions, so the list of a term is what exploding it
gives, and whether another term stands at an offset is one look into the same row. Test items are
cut into windows of WINDOW consecutive words (an item of fewer words is one window). Occurrences
of terms are counted over all training documents. Each window is searched from the list of its
rarest term alone: the positions of that list, less the term's offset, are the starts, which are
intersected with the lists of the next rarer terms at their offsets and then with those of all
other words, so what is left are exact phrase matches. A window of common words costs one list.
Documents are read in place; only matches are shuffled. ``phrase_matches`` gives them as rows;
``proximity_matches`` gives test terms that occur in order within a span.

Test windows go to every task in blocks of at most BLOCK_WINDOWS (some 200 bytes each: 20 MB); a
larger test set takes more passes over the stored postings.

Words are runs of a-z (A-Z lower-cased), 0-9 and characters over U+007F. Defined cases: a null
text has no words, hits or items; an item without words has no window; equal items all count.
Repeated rows of documents are judged each. An empty table on either side gives no hit. A phrase
without words has no proximity match. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.llm.common import Workspace, staged, workspace

WINDOW, KEYS = 10, 3
#: Test words that are sent to every task: some 100 bytes each in a hash table.
BROADCAST_TERMS = 200_000
BLOCK_WINDOWS = 100_000
#: Documents with hits, some 100 bytes each, up to which they are sent to every task: 50 MB.
BROADCAST_HITS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    split = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NO_WORD)
    return F.filter(split, lambda w: w != "")


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id (as string), window (its hash), words: the windows of every item."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return rows.select("item_id", F.sha2(F.array_join("words", " "), 256).alias("window"), "words").distinct()


def indexed(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, w: the positional postings of each document. Stage it
    before use: the numbers are fixed when it is written."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("w"))


def keyed_windows(windows: DataFrame, index: DataFrame, keys: int = KEYS) -> DataFrame:
    """window, words, term and offset of its rarest word, others: offsets of the next rarer ones
    from the rarest on. A window with a word that no document has is left out. Only words of windows are
    counted in the documents; up to BROADCAST_TERMS of them go to every task, so no others are shuffled."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    counts = index.select(F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    offsets = windows.select("window", F.posexplode("words").alias("offset", "term"))
    ranked = offsets.join(counts, "term", "left").fillna(0, ["n"]).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("r"))
    ranked = ranked.where(F.col("r")[0]["n"] > 0)  # at most WINDOW words each
    others = F.transform(F.slice("r", F.lit(2), F.lit(keys - 1)), lambda x: x["offset"])
    return windows.join(ranked, "window").select("window", "words", F.col("r")[0]["term"].alias("term"), F.col("r")[0]["offset"].alias("offset"), others.alias("others"))


def matches(index: DataFrame, windows: DataFrame, keys: int = KEYS) -> DataFrame:
    """row, doc_id, start, n, window: every occurrence of a window of ``keyed_windows``."""
    lists = index.select("row", "doc_id", "w", F.posexplode("w").alias("pos", "term"))
    found = lists.join(F.broadcast(windows), "term").withColumn("start", F.col("pos") - F.col("offset"))
    agree = (F.col("start") >= 0) & (F.col("start") + F.size("words") <= F.size("w"))
    for k in range(keys - 1):
        at = F.get("others", F.lit(k))
        agree = agree & F.coalesce(F.get("w", F.col("start") + at) == F.get("words", at), F.lit(True))
    exact = F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words")
    return found.where(agree & exact).select("row", "doc_id", "start", F.size("words").alias("n"), "window")


def _found(index: DataFrame, windows: DataFrame, stage: Workspace, keys: int) -> DataFrame:
    """``matches`` of all windows, block by block."""
    keyed = stage(keyed_windows(windows.select("window", "words").distinct(), index, keys), "window-keys")
    blocks = max(1, -(-keyed.count() // BLOCK_WINDOWS))
    found = None
    for k in range(blocks):
        block = stage(matches(index, keyed.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k), keys), "matches")
        found = block if found is None else found.unionByName(block)
    return found


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, keys: int = KEYS) -> DataFrame:
    """doc_id, start, n_words, item_id: every exact occurrence of a test window."""
    with workspace(docs.sparkSession) as stage:
        index, windows = stage(indexed(docs), "postings"), stage(windows_of(items, size), "test-windows")
        found = _found(index, windows, stage, keys).join(windows.select("window", "item_id"), "window")
        return staged(found.select("doc_id", "start", F.col("n").alias("n_words"), "item_id"), "phrase-matches")


def _postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """row, pos, term for the words of ``index`` among ``terms`` (term)."""
    return index.select("row", F.posexplode("w").alias("pos", "term")).join(terms, "term")


def proximity_matches(docs: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """phrase_id, doc_id, start, end: occurrences of all words of a phrase, in order, within
    ``span`` words; the shortest for each start. ``phrases``: phrase_id, text. The list of the first
    word is carried along the others by an as-of step over the merged positions."""
    terms = phrases.select("phrase_id", F.posexplode(words_of(F.col("text"))).alias("k", "term"))
    lengths = terms.groupBy("phrase_id").agg((F.max("k") + 1).alias("length"))
    index = staged(indexed(docs), "postings")
    stored = staged(_postings(index, terms).select("row", "phrase_id", "pos", "k"), "proximity-postings")
    longest = lengths.agg(F.max("length")).first()[0] or 0
    live = stored.where("k = 0").select("row", "phrase_id", F.col("pos").alias("start"), F.col("pos").alias("end"))
    done = None
    for k in range(1, longest + 1):
        ended = live.join(lengths.where(F.col("length") == k), "phrase_id").select("phrase_id", "row", "start", "end")
        done = ended if done is None else done.union(ended)
        nxt = stored.where(F.col("k") == k).select("row", "phrase_id", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "pos")
        both = live.withColumn("pos", F.col("end")).unionByName(nxt)
        # The next word's nearest position after each end; ends sort after words at the same place.
        order = W.partitionBy("row", "phrase_id").orderBy(F.desc("pos"), F.col("start").isNull().cast("int")).rowsBetween(W.unboundedPreceding, -1)
        step = both.withColumn("next", F.last(F.when(F.col("start").isNull(), F.col("pos")), ignorenulls=True).over(order))
        live = step.where("start IS NOT NULL AND next IS NOT NULL").where(F.col("next") - F.col("start") < span).select("row", "phrase_id", "start", F.col("next").alias("end"))
    if done is None:
        done = live.select("phrase_id", "row", "start", "end")
    return done.join(index.select("row", "doc_id"), "row").select("phrase_id", "doc_id", "start", "end")


def decontamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, keys: int = KEYS) -> DataFrame:
    """Contract columns."""
    with workspace(docs.sparkSession) as stage:
        index, windows = stage(indexed(docs), "postings"), stage(windows_of(items, size), "test-windows")
        found = _found(index, windows, stage, keys)
        # What each match adds beyond the furthest end so far.
        before = W.partitionBy("row").orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1)
        end = F.col("start") + F.col("n")
        places = found.select("row", "start", "n").distinct().withColumn("past", F.coalesce(F.max(end).over(before), F.lit(0)))
        hits = places.groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "past"))).cast("long").alias("n_hit"))
        named = found.select("row", "window").distinct().join(windows.select("window", "item_id"), "window")
        named = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        hits = stage(hits.join(named, "row"), "hits")
        if hits.count() <= BROADCAST_HITS:
            hits = F.broadcast(hits.withColumns(_item_columns()).drop("items"))
        else:
            hits = hits.withColumns(_item_columns()).drop("items")
        rows = index.select("row", "doc_id", F.size("w").cast("long").alias("n_words")).join(hits, "row", "left")
        return staged(
            rows.select(
                "doc_id",
                "n_words",
                F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                F.coalesce("n_items", F.lit(0)).alias("n_items"),
                F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            ),
            "decontamination",
        )


def _item_columns() -> dict[str, Column]:
    return {"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[s : s + 9] AS v FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(v) AS n FROM bw),
dw AS (SELECT r, s, n, w[s : s + n - 1] AS v FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, s, n, item_id FROM dw JOIN bw USING (v)),
p AS (SELECT DISTINCT r, unnest(range(s, s + n)) AS k FROM m),
h AS (SELECT r, count(*) AS n_hit FROM p GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
