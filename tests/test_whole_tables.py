"""Queries over whole tables, where the SQL of an older query keeps a part of the rows."""

import os
import random

import pytest

from parley.operators.ordered import ordered_groups, overlap_rule
from parley.operators import greedy
from parley.plans import relations, semantics


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(os.path.join(str(folder), f"{name}.parquet"))


def alignment_by_hand(lines):
    """{(smallest id, parts, suppliers, status)} by plain union-find."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for ev, part, _, n in lines:
        for other, _, supp, m in lines:
            if ev == other and n == 1 and m == 2:
                a, b = sorted((find(2 * part), find(2 * supp + 1)))
                up[b] = a
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), []).append(x)
    return {(r, sum(x % 2 == 0 for x in g), sum(x % 2 for x in g), "matched" if len(g) == 2 else "ambiguous") for r, g in groups.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment_of_all_orders(spark, tmp_path, seed):
    rng = random.Random(seed)
    # Keys beyond 100000 on both sides, and orders that no step of forty holds.
    lines = [(ev, rng.choice([1, 2, 3, 100_001]) + 10 * (ev % 9), rng.randrange(1, 9) + 10 * (ev % 9), n) for ev in range(1, 60) for n in (1, 2, 3)]
    save(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    got = {tuple(r) for r in relations.bipartite_alignment(spark, str(tmp_path)).collect()}
    assert got == alignment_by_hand(lines) and len(got) > 1


def test_evidence_of_all_orders_and_codes(spark, tmp_path):
    urgent, high, low = "1-URGENT", "2-HIGH", "5-LOW"
    # Orders 1 and 4 are no multiples of three; code 20 is past the first twelve.
    save(spark, tmp_path, "orders", [(1, 7, urgent), (4, 7, high), (3, 8, low), (5, 9, "3-MEDIUM"), (7, 10, urgent)], "o_orderkey long, o_custkey long, o_orderpriority string")
    save(spark, tmp_path, "supplier", [(20,), (21,), (23,)], "s_suppkey long")
    got = {tuple(r) for r in relations.evidence_overlap_join(spark, str(tmp_path)).collect()}
    assert got == {(7, 20, "exact"), (8, None, "ambiguous"), (9, None, "none"), (10, None, "ambiguous")}


def test_acu_evaluation_of_all_claims(spark, tmp_path):
    # must: 3, 6; may: 1; exclude: 2, 5. No claim is a multiple of nine.
    save(spark, tmp_path, "lineitem", [(1, 3), (1, 2), (2, 2), (4, 1), (5, 5), (7, 3)], "l_orderkey long, l_partkey long")
    (r,) = relations.acu_evaluation(spark, str(tmp_path)).collect()
    assert (r["claims"], r["precision"], r["must_recall"], r["unsupported"]) == (5, 0.6, 1.0, 2)


def groups_by_hand(leads):
    groups = []
    for lead in sorted(leads):
        refs = leads[lead]
        home = next((g for g in groups if refs & g[1] and len(refs & g[1]) >= max(1, (min(len(refs), len(g[1])) + 1) // 2)), None)
        if home is None:
            home = (lead, set(), [])
            groups.append(home)
        home[1].update(refs)
        home[2].append(lead)
    return {(x, first) for first, _, members in groups for x in members}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_citation_groups_of_all_leads(spark, tmp_path, seed):
    rng = random.Random(seed)
    # Five blocks of references; the union of a group decides about later leads.
    lines = [(lead, 100 * (lead % 5) + rng.randrange(1, 24)) for lead in range(1, 120) for _ in range(rng.randrange(1, 7))] + [(500, None)]
    save(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_suppkey long")
    leads = {}
    for lead, ref in lines:
        leads.setdefault(lead, set()).update({ref} - {None})
    got = {tuple(r) for r in semantics.citation_groups(spark, str(tmp_path)).collect()}
    assert got == groups_by_hand(leads) and len({g for _, g in got}) > 5


def test_citation_groups_merge_unions(spark):
    rows = [(0, 1, [1, 2]), (0, 2, [2, 3, 4, 5]), (0, 3, [4, 5]), (0, 4, [3, 6, 7, 8]), (0, 5, [1, 3, 6, 9])]
    for block in (2, 100):
        got = dict(ordered_groups(spark.createDataFrame([r[1:] for r in rows], "pos long, refs array<long>"), overlap_rule(50), block).collect())
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}


@pytest.mark.parametrize("seed, refs, width, block", [(1, 60, 5, 40), (2, 400, 4, 20), (3, 12, 3, 15)])
def test_rounds_of_ordered_groups_equal_the_loop(spark, seed, refs, width, block):
    rng = random.Random(seed)
    leads = {i: {rng.randrange(refs) for _ in range(rng.randrange(width + 1))} for i in range(0, 240, 2)}
    got = {tuple(r) for r in ordered_groups(spark.createDataFrame([(i, sorted(r)) for i, r in leads.items()], "pos long, refs array<long>"), overlap_rule(50), block).collect()}
    assert got == groups_by_hand(leads)


def test_guarded_draw_goes_on_past_a_block_of_copies(spark):
    rows = [(i, "a", 0, ["x", "y"]) for i in range(1, 31)] + [(100 + i, "ab"[i % 2], 1, [f"t{i}", f"u{i // 2}"]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, source string, s int, terms array<string>")
    drawn = greedy.rounds(df, "source", ["s", "id"]).orderBy("round", "source").toPandas()
    want = greedy.guarded_sample(drawn, 6, 0.3)
    assert greedy.guarded_draw(df, "source", ["s", "id"], 6, 0.3, 4) == want and len(want) == 6
    assert greedy.guarded_draw(df, "source", ["s", "id"], 50, 0.3, 4) == greedy.guarded_sample(drawn, 50, 0.3)


@pytest.mark.parametrize("seed", [1, 2])
def test_budgeted_sees_every_kind_of_package(spark, seed):
    rng = random.Random(seed)
    # 600 packages of one scope score best; those with new labels come after them.
    rows = [(i, 50, ["en"], "hot") for i in range(600)] + [(600 + i, rng.randrange(20, 49), rng.sample(["de", "fr", "mail", "table"], 2), rng.choice("abc")) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, score long, labels array<string>, scope string")
    want = greedy.budgeted(df.toPandas(), 10)
    assert greedy.budgeted(greedy.best_of_kind(df, 10).toPandas(), 10) == want and max(want) >= 600


def cover_by_hand(docs, k):
    """[(page, place)] by the rule over all pages."""
    pages = {i: set(labels) for i, labels in docs}
    n = {x: sum(x in v for v in pages.values()) for v in pages.values() for x in v}
    chosen, covered = [], set()
    while len(chosen) < k and set(n) - covered:
        label = min(set(n) - covered, key=lambda x: (n[x], x))
        left = [i for i in pages if label in pages[i] and i not in chosen]
        if not left:
            covered.add(label)
            continue
        chosen.append(min(left, key=lambda i: (-len(pages[i] - covered), i)))
        covered |= pages[chosen[-1]]
    return {(p, i) for i, p in enumerate(chosen)}


def test_cover_sees_pages_past_the_smallest_ids(spark, tmp_path):
    # Page 90 covers en and plain first. Of hot, the next label, page 50 alone has more new ones.
    docs = [(i, "hi", "en", "hot") for i in range(1, 21)] + [(50, "a@b", "de", "hot"), (90, "hi", "en", "rare")] + [(100 + i, "a@b" if i % 2 else "hi", ["en", "de", "fr"][i % 3], "cold") for i in range(120)]
    save(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string")
    want = cover_by_hand([(i, [lang, source, "mail" if "@" in t else "plain"]) for i, t, lang, source in docs], 10)
    got = {(r["page"], r["place"]) for r in relations.stratum_cover(spark, str(tmp_path)).collect()}
    assert got == want


def test_anchor_limit_follows_the_number_of_documents(spark, tmp_path):
    assert [semantics.most_anchored(n) for n in (10, 200, 300, 10_000)] == [8, 16, 24, 24]
    # 20 of 300 documents share three terms; 30 share three others, which are too common.
    text = lambda i: "aaaaaaaaaaaa bbbbbbbbbbbb cccccccccccc" if i < 20 else "dddddddddddd eeeeeeeeeeee ffffffffffff" if i < 50 else "short"
    save(spark, tmp_path, "documents", [(i, text(i), "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in semantics.anchor_event_clusters(spark, str(tmp_path)).collect()} == {(i, 0) for i in range(20)}
    got = semantics.anchor_proposals(spark, str(tmp_path)).collect()
    assert {(r["anchor"][0], r["members"], r["lead"]) for r in got} == {(x, 20, 0) for x in "abc"}
