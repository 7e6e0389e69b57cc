"""N-gram Jaccard join by prefix filters under several global token orders.

A document is its set of distinct 5-word shingles (of all its words, if fewer), as hashes.
Documents with equal sets are one class and searched once. What can't be linked leaves in steps
of growing cost, each of them exact:

* Under the order of hashes, the first n - ceil(t n) + l shingles of a set of n hold at least
  l(ceil(t n)) shingles of any partner, l being FIRST per cent. Sets whose prefixes share fewer
  with anything leave. Only these prefixes are stored for all documents; the sets of those that
  are left are made again from their texts.
* A set of n that shares fewer than ceil(t n) shingles with all other sets together leaves.
* Of the others, the shingles that others have too are put into two global orders, both rare ones
  first: by frequency and hash, and by the logarithm of the frequency and descending hash. Two
  sets of n and m overlap by at least a = ceil(t / (1 + t) (n + m)), so under any order their
  first common shingle has a - 1 of the shared ones after it on either side. Candidates share a
  shingle whose places under the first order leave that much for their own two sizes, and have
  shingles in common in their prefixes under the second order; only then are sets compared.
  Shingles that no one else has weigh in here: near copies of one text that differ too much from
  each other have too many of these to meet at all.

Pairs are never expanded within a group. First each class is compared with one pivot, a row of
common shingles in its groups; classes that pass form trees. Groups whose members lie in one
tree need no more. From the others come pairs between different trees, only of rows outside a
group's largest tree. Components of the verified links are found by minimum labels with pointer
jumping, staged in the shared folder.

Defined cases: a null text or one without words has an empty set (n_shingles 0) and is linked
with nothing; its component is its own id. Rows that share a doc_id are searched each by its own
text and get the component of that text. A row without doc_id takes the component of its class,
or none. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Workspace, chunks, filled, raw_text, staged, workspace

SHINGLE, PERCENT = 5, 80
#: Rows of a few numbers up to which a table goes to every task (at most some 50 MB there); more
#: are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles of a group that are counted together, and rows of one whose counts are summed together.
BUCKET_TOKENS, PART_IDS = 150_000, 50_000
EMIT_TOKENS = 400_000
#: Equal sets that a task knows of; a set seen beyond it is counted again, which lets it pass on.
SEEN_SETS = 50_000
STAR_ROUNDS = 1
#: Per cent of a set by which the first prefixes are longer than needed for one common shingle.
FIRST = 6
MASK = np.uint64((1 << 47) - 1)
#: Marks a shingle that a task has found in several sets.
SHARED = np.uint64(1 << 47)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_random = np.random.default_rng(20240229)
PLACES = _random.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TURNS = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of a null-free string array."""
    raw, offsets = raw_text(column)
    if not len(raw):
        return [np.zeros(0, np.uint64)] * len(column)
    blank = BLANK[raw]
    before = np.concatenate([[True], blank[:-1]])
    before[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(~blank & before)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(column)
    letters = np.flatnonzero(~blank)
    word = np.cumsum((~blank & before)[letters]) - 1
    place = letters - starts[word]
    parts = LOWER[raw[letters]] * PLACES[place & 4095] * (np.uint64(2) * (place >> 12).astype(np.uint64) + np.uint64(1))
    words = mixed(np.add.reduceat(parts, np.searchsorted(letters, starts)))
    bounds = np.searchsorted(starts, offsets)
    grams = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        grams += words[k : len(words) - size + 1 + k] * TURNS[k] if len(grams) else grams
    grams = mixed(grams)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * TURNS[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def required(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def common_prefix(n: int, share: int) -> int:
    return max(1, -(-share * n // 100))


def extended_prefix(n: int, percent: int, share: int) -> int:
    return n - required(n, percent) + common_prefix(n, share)


def with_sets(docs: DataFrame, percent: int, share: int | None) -> DataFrame:
    """doc_id, n_shingles, n, sig (hash of the whole set, null without one), tokens (n 47-bit hashes,
    sorted, six bytes each): the whole set, or its extended prefix if ``share`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(filled(part.column(1)))
                tokens = [np.unique(s & MASK) for s in sets]
                sizes = [len(t) for t in tokens]
                if share is not None:
                    tokens = [t[: extended_prefix(len(t), percent, share)] for t in tokens]
                sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(map(packed, tokens), pa.binary())], names=["doc_id", "n_shingles", "n", "sig", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, n long, sig binary, tokens binary")


def shared_counts(sets: DataFrame) -> DataFrame:
    """id, shared: how many of a row's shingles another row has too. ``sets``: id, sig, tokens. Rows of
    one task with equal sig count once. A shingle that a task meets in several rows is counted
    there and sent on once, so a common one is no hot key."""
    size = sets.agg(F.sum(F.octet_length("tokens")).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(8, math.ceil((size["bytes"] or 0) / 6 / BUCKET_TOKENS))
    parts = max(8, math.ceil(size["n"] / PART_IDS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tokens, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            t, i = np.concatenate(tokens), np.concatenate(ids)
            distinct, first, inverse, n = np.unique(t, return_index=True, return_inverse=True, return_counts=True)
            done, times = np.unique(i[n[inverse] > 1], return_counts=True)
            t, i = np.where(n > 1, distinct | SHARED, distinct), i[first]
            b = (distinct % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            t, i, b = t[by], i[by], b[by]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
            spans, empty = list(zip(cuts[:-1], cuts[1:])), [b""] * (len(cuts) - 2)
            lucky = int(distinct[0]) % len(spans)  # which bucket takes along what is counted
            place = lambda x: [*empty[:lucky], x, *empty[lucky:]]
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array(b[cuts[:-1]].astype(np.int32)), "tokens": pa.array([packed(t[x:y]) for x, y in spans], pa.binary()), "ids": pa.array([i[x:y].tobytes() for x, y in spans], pa.binary()),
                "done": pa.array(place(done.tobytes()), pa.binary()), "times": pa.array(place(times.astype(np.int64).tobytes()), pa.binary()),
            })

        for batch in batches:
            for key, sig, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not raw or sig in seen:
                    continue
                if len(seen) < SEEN_SETS:
                    seen.add(sig)
                own = unpacked(raw)
                tokens.append(own)
                ids.append(np.full(len(own), key, np.int64))
                held += len(own)
                if held >= EMIT_TOKENS:
                    yield flush()
                    tokens, ids, held = [], [], 0
        if held:
            yield flush()

    def count(groups: pa.Table) -> pa.Table:
        t = np.concatenate([unpacked(x) for x in groups.column("tokens").to_pylist()])
        i = np.concatenate([np.frombuffer(x, np.int64) for x in groups.column("ids").to_pylist()])
        marked = t >= SHARED
        _, inverse, n = np.unique(t & MASK, return_inverse=True, return_counts=True)
        own, times = np.unique(i[(n[inverse] > 1) & ~marked], return_counts=True)
        ids, n = summed(groups, "done", "times", own, times)
        part = (mixed(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(parts + 1))
        spans = [(k, by[x:y]) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        return pa.table({"part": pa.array([k for k, _ in spans], pa.int32()), "ids": pa.array([ids[x].tobytes() for _, x in spans], pa.binary()), "n": pa.array([n[x].tobytes() for _, x in spans], pa.binary())})

    def total(groups: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("id", "shared"), map(pa.array, summed(groups, "ids", "n")))))

    found = sets.select("id", "sig", "tokens").mapInArrow(emit, "bucket int, tokens binary, ids binary, done binary, times binary")
    return found.groupBy("bucket").applyInArrow(count, "part int, ids binary, n binary").groupBy("part").applyInArrow(total, "id long, shared long")


def summed(groups: pa.Table, ids: str, n: str, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of packed columns (and of ``more``) and the sums of their counts."""
    columns = [[np.frombuffer(x, np.int64) for x in groups.column(c).to_pylist()] for c in (ids, n)]
    found, inverse = np.unique(np.concatenate([*more[:1], *columns[0]]), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate([*more[1:], *columns[1]]), len(found)).astype(np.int64)


def least_shared(n: Column, percent: int, share: int) -> Column:
    """common_prefix of the smallest partner of a set of n."""
    return F.greatest(F.lit(1), F.ceil(share * F.ceil(percent * n / 100) / 100)).cast("int")


def prefixes(sets: DataFrame, percent: int, stage: Workspace) -> DataFrame:
    """id, n, shared (its shingles that other sets have too), kept and kept2 (those that a partner must
    have one of, under either order), weight (mean logarithm of the frequencies). ``sets``: id, n, tokens."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            if raw:
                sizes = [len(x) // 6 for x in raw]
                ids, n = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(unpacked(b"".join(raw)).view(np.int64))], names=["id", "n", "token"])

    rows = sets.select("id", "n", "tokens").mapInArrow(emit, "id long, n long, token long")
    common = stage(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    lists = rows.join(common, "token").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    lists = lists.withColumn("shared", F.size("t")).withColumn("keep", (F.col("shared") - F.ceil(percent * F.col("n") / 100) + 1).cast("int")).where("keep > 0")
    second = F.sort_array(F.transform("t", lambda x: F.struct(F.floor(F.log2(x["df"].cast("double"))).alias("d"), (-x["token"]).alias("token"))))
    return lists.select(
        "id", "n", "shared",
        F.transform(F.slice("t", F.lit(1), F.col("keep")), lambda x: x["token"]).alias("kept"),
        F.transform(F.slice(second, F.lit(1), F.col("keep")), lambda x: -x["token"]).alias("kept2"),
        (F.aggregate("t", F.lit(0.0), lambda s, x: s + F.log(x["df"].cast("double"))) / F.col("n")).alias("weight"),
    )


def _small(df: DataFrame) -> DataFrame:
    """A staged table as a broadcast if it is small enough, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def may_link(percent: int) -> Column:
    """Of rows with both sides' columns (the second one's with a y_): whether sizes and places leave
    enough shingles from here on."""
    n, m = F.col("n"), F.col("y_n")
    left = lambda y: (100 + percent) * (F.col(f"{y}shared") - F.col(f"{y}place")) >= percent * (n + m)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & left("") & left("y_")


def under_second_order(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose prefixes under the second order meet."""
    left, right = (lists.select(F.col("id").alias(c), F.col("kept2").alias(f"kept_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("kept_a", "kept_b")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                i = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
                ok.append(100 * i >= percent * ((len(x) + len(y)) // 6 - i))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, stage: Workspace) -> DataFrame:
    """id, root: the smallest id that edges (a, b) reach from each id they name."""
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), "labels")
    while True:
        known = labels.select(F.col("id").alias("b"), "root")
        near = both.join(_small(known), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        step = stage(step, "labels")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("next"))
        after = stage(step.join(_small(jump), "new").select("id", F.least("new", "next").alias("root"), (F.least("new", "next") != F.col("old")).alias("moved")), "labels")
        labels = after.select("id", "root")
        if not after.where("moved").limit(1).count():
            return labels


def stars(tokens: DataFrame, percent: int) -> DataFrame:
    """a, b: candidate links of rows (token, place, id, root, n, shared, weight) with a pivot. The pivot of
    a shingle group is its row with the most common shingles, which near copies differ least
    from; each row is held against the one pivot of another tree that it meets most often."""
    own = ("id", "root", "n", "shared", "place")
    pivots = tokens.groupBy("token").agg(F.max_by(F.struct(*own), F.struct("weight", -F.col("id"))).alias("p"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    met = tokens.join(pivots.select("token", *[F.col(f"p.{c}").alias(f"y_{c}") for c in own]), "token").where((F.col("root") != F.col("y_root")) & may_link(percent))
    met = met.groupBy("id", F.col("y_id").alias("pivot")).agg(F.count("*").alias("n"))
    return met.groupBy(F.col("id").alias("a")).agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("b"))


def linked_classes(sets: DataFrame, percent: int, stage: Workspace) -> DataFrame:
    """id, root of the distinct sets (id, n, sig, tokens) that are linked with another."""
    enough = shared_counts(sets).join(sets.select("id", "n"), "id").where(F.col("shared") >= F.ceil(percent * F.col("n") / 100))
    sets = stage(sets.join(_small(stage(enough.select("id"), "enough-shared")), "id", "left_semi"), "sets-with-enough-shared")
    lists = stage(prefixes(sets, percent, stage), "prefixes")
    groups = lists.select("id", "n", "shared", "weight", F.posexplode("kept").alias("place", "token"))
    links, rooted = None, None
    for _ in range(STAR_ROUNDS):
        now = groups.withColumn("root", F.col("id")) if rooted is None else groups.join(_small(rooted), "id", "left").withColumn("root", F.coalesce("root", "id"))
        found = under_second_order(stage(stars(now, percent), "pivots"), lists)
        found = stage(verified(found, sets, percent), "stars")
        links = found if links is None else links.unionByName(found)
        rooted = components(links, stage)
    # Pairs between different trees that share a kept shingle: rows outside the largest tree of a
    # group against all of its rows.
    rows = groups.drop("weight").join(_small(rooted), "id", "left").withColumn("root", F.coalesce("root", "id"))
    trees = rows.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.count("*").alias("trees")).where("trees > 1")
    rows = stage(rows.join(trees.select("token", "top"), "token").withColumn("inside", F.col("root") == F.col("top")).drop("top"), "open-groups")
    other = rows.select("token", *[F.col(c).alias(f"y_{c}") for c in rows.columns if c != "token"])
    fits = (F.col("root") != F.col("y_root")) & (F.col("y_inside") | (F.col("id") < F.col("y_id"))) & may_link(percent)
    pairs = rows.where("NOT inside").join(other, "token").where(fits).select(F.least("id", "y_id").alias("a"), F.greatest("id", "y_id").alias("b")).distinct()
    pairs = stage(under_second_order(stage(pairs, "order-1-pairs"), lists), "both-orders-pairs")
    return components(links.unionByName(verified(pairs, sets, percent)), stage)


def ngram_jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Contract columns: doc_id, n_shingles, component_id."""
    with workspace(docs.sparkSession) as stage:
        first = stage(with_sets(docs, percent, FIRST), "first-prefixes")
        every = stage(first.drop("tokens"), "signatures")
        counts = shared_counts(first.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id"))
        known = every.where("sig IS NOT NULL AND doc_id IS NOT NULL")
        near = known.join(counts.withColumnRenamed("id", "doc_id"), "doc_id").where(F.col("shared") >= least_shared(F.col("n"), percent, FIRST))
        near = stage(near.groupBy("sig", "doc_id").agg(F.count("*").alias("copies")), "may-have-partners")
        stage.drop(first)
        # Of equal sets one goes on, under a number of its own: rows that share a doc_id may differ.
        classes = stage(known.groupBy("sig").agg(F.min("doc_id").alias("class_id")), "classes")
        chosen = near.groupBy("sig").agg(F.min_by("copies", "doc_id").alias("copies"), F.min("doc_id").alias("doc_id"))
        chosen = stage(chosen.withColumn("id", F.monotonically_increasing_id()), "chosen")
        texts = docs.join(_small(stage(chosen.select("doc_id").distinct(), "chosen-rows")), "doc_id", "left_semi")
        made = with_sets(texts, percent, None).join(_small(chosen), ["doc_id", "sig"])
        made = made.select("copies", "id", "n", "sig", "tokens")
        sets = made.where("copies = 1").unionByName(made.where("copies > 1").dropDuplicates(["id"])).drop("copies")
        linked = stage(linked_classes(stage(sets, "distinct-sets"), percent, stage), "components")
        named = stage(chosen.join(_small(linked), "id").join(classes, "sig").select("sig", "root", "class_id"), "linked-classes")
        named = named.join(_small(stage(named.groupBy("root").agg(F.min("class_id").alias("component")), "smallest-ids")), "root")
        found = stage(classes.join(_small(stage(named.select("sig", "component"), "named")), "sig", "left").select("sig", F.coalesce("component", "class_id").alias("component")), "class-components")
        out = every.select("doc_id", "n_shingles", "sig").join(found, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        return staged(out, "jaccard-components")


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (n + m - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT doc_id, len(g) AS n_shingles, (SELECT min(c) FROM r WHERE r.a = s.doc_id) AS component_id FROM s
"""
