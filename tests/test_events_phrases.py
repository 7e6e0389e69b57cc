"""Event proposals and their merging, phrases with reactions, thinning of copies, broken invariants."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.operators import events, phrases
from parley.operators.thinning import thinned
from parley.plans import dialogue

HOUR = 3_600_000_000
ITEMS = "id long, chat string, person string, us long, points long, telling boolean, private boolean, asking boolean, terms array<string>, domains array<string>, topics array<string>"


def some_items(seed, n=110):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        domains = rng.choice([[], [], [], ["a"], ["b"], ["a", "b"]])
        topics = sorted(set(domains) | set(rng.sample(["t1", "t2", "weak"], rng.randint(0, 3))))
        terms = sorted({f"term{rng.randrange(25)}" for _ in range(rng.randint(1, 6))})
        out.append((i, f"c{rng.randrange(4)}", f"p{rng.randrange(3)}", i * 2 * HOUR, rng.randint(0, 90), rng.random() < 0.6, rng.random() < 0.1, rng.random() < 0.3, terms, domains, topics))
    return out


def quality_by_hand(n, chats, specific, topics, fits):
    crossing = chats >= 2
    supported = fits and (n <= 1 or not crossing or topics > 0 or specific >= 2)
    score = 25 + min(24, 6 * n) + min(18, 7 * chats) + min(18, 7 * specific) + 15 * (topics > 0) + 8 * crossing - 18 * (crossing and not supported) - 45 * (not fits)
    sure = 38 + min(22, 6 * n) + min(15, 6 * chats) + min(16, 6 * specific) + 12 * (topics > 0) - 20 * (crossing and not supported) - 35 * (not fits)
    return supported, max(0, min(100, score)), max(20, min(95, sure))


def fits_by_hand(items):
    found = set().union(*(set(x[9]) for x in items))
    return len(found) <= 1 or all(found <= set(x[9]) for x in items)


def proposals_by_hand(items, rules, most):
    out = []
    for term in sorted({t for x in items for t in x[8]}):
        own = [x for x in items if term in x[8]]
        domains = set().union(*(set(x[9]) for x in own))
        lanes = {}
        for x in own:
            lanes.setdefault("one" if len(domains) <= 1 else ",".join(sorted(x[9])), []).append(x)
        for lane in lanes.values():
            chats, points = len({x[1] for x in lane}), max(x[4] for x in lane)
            if not 2 <= len(lane) <= most or max(x[3] for x in lane) - min(x[3] for x in lane) > rules.span_us or sum(x[5] for x in lane) < 2:
                continue
            if points < rules.least_points and not (chats >= 2 and len(lane) >= 3):
                continue
            topics = set.intersection(*(set(x[10]) for x in lane)) - set(rules.weak_topics)
            specific = len(set.intersection(*(set(x[8]) for x in lane)))
            supported, score, sure = quality_by_hand(len(lane), chats, specific, len(topics), fits_by_hand(lane))
            if chats < 2 or supported:
                out.append((chats, points, len(lane), len(term), term, sorted(x[0] for x in lane), topics, score, sure))
    return sorted(out, reverse=True, key=lambda p: p[:6])


def merged_by_hand(found, items, rules):
    by_id, groups = {x[0]: x for x in items}, []

    def topics(ids):
        return set.intersection(*(set(by_id[i][10]) for i in ids)) - set(rules.weak_topics)

    for *_, ids, _, _, _ in found:
        ids = set(ids)
        for g in groups:
            if len(ids & g) * 100 >= rules.join_percent * min(len(ids), len(g)) and topics(ids) & topics(g) and fits_by_hand([by_id[i] for i in ids | g]):
                g |= ids
                break
        else:
            if not any(len(ids & g) * 100 >= rules.drop_percent * min(len(ids), len(g)) for g in groups):
                groups.append(set(ids))
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("seed, block", [(1, 3), (2, 1000)])
def test_events_equal_the_loop(spark, seed, block):
    items, rules = some_items(seed), events.EventRules(weak_topics=("weak",))
    df = spark.createDataFrame(items, ITEMS)
    found = events.proposals(df, rules, 12)
    want = proposals_by_hand(items, rules, 12)
    got = sorted(((r.chats, r.points, r.n, len(r.term), r.term, r.members, set(r.topics), r.score, r.confidence) for r in found.collect()), reverse=True, key=lambda p: p[:6])
    assert got == want and len(want) > 8
    groups = {}
    for r in events.events(found, rules, block).collect():
        groups.setdefault(r["event"], []).append(r["id"])
    assert sorted(map(sorted, groups.values())) == merged_by_hand(want, items, rules)


def test_briefs_of_events_and_single_items(spark):
    items = some_items(7)
    rules = events.EventRules(weak_topics=("weak",))
    df = spark.createDataFrame(items, ITEMS)
    members = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 3), (2, 4)], "event long, id long")
    found = {r["lead"]: r for r in events.briefs(df, members, rules).collect()}
    for x in items[5:]:
        alone = x[4] >= 65 or (x[4] >= 45 and x[9]) or (x[6] and x[7])
        assert (x[0] in found) == bool(alone)
        if alone:
            assert found[x[0]]["lane"] == ("for_me" if x[6] or x[7] else "pending") and found[x[0]]["status"] == "pending"
    for lead, ids in ((0, (0, 1, 2)), (3, (3, 4))):
        own = [items[i] for i in ids]
        chats, told = len({x[1] for x in own}), sum(x[4] >= 25 for x in own)
        common = set.intersection(*(set(x[8]) for x in own)) or set().union(*(set(x[8]) for x in own))
        topics = set.intersection(*(set(x[10]) for x in own)) - {"weak"}
        supported, score, sure = quality_by_hand(len(own), chats, len(common), len(topics), fits_by_hand(own))
        shown = (told >= 2 or chats >= 3 if chats >= 2 else told >= 2) and fits_by_hand(own) and (chats < 2 or supported)
        assert (lead in found) == shown
        if shown:
            assert (found[lead]["score"], found[lead]["confidence"]) == (score, sure)


def runs(words, low, high):
    return {" ".join(words[i : i + k]) for k in range(low, high + 1) for i in range(len(words) - k + 1)}


def test_repeated_phrases_equal_plain_counts(spark):
    rng = random.Random(5)
    rows = [(i % 2, i, [f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 9))]) for i in range(60)] + [(0, 100, None), (0, 101, [])]
    used = Counter((chat, g) for chat, _, words in rows for g in runs(words or [], 2, 5))
    kept = {x: n for x, n in used.items() if n >= 2}
    want = {(c, g, n) for (c, g), n in kept.items() if not any(c == d and n == m and g != h and f" {g} " in f" {h} " for (d, h), m in kept.items())}
    got = {tuple(r) for r in phrases.repeated_phrases(spark.createDataFrame(rows, "chat long, id long, words array<string>"), 2, 5, 2).select("chat", "gram", "n").collect()}
    assert got == want and len(got) < len(kept)


def test_reactions_go_to_the_last_message(spark):
    rng = random.Random(6)
    rows = [(c, i, rng.randrange(4000), rng.random() < 0.4) for c in range(3) for i in range(80)]
    want = Counter()
    for c, i, us, reaction in rows:
        before = [(u, j) for d, j, u, r in rows if d == c and not r and (u, j) < (us, i)]
        if reaction and before and us - max(before)[0] <= 50:
            want[c, max(before)[1]] += 1
    got = {(r["chat"], r["id"]): r["reactions"] for r in phrases.reactions(spark.createDataFrame(rows, "chat long, id long, us long, reaction boolean"), 50).collect()}
    assert got == dict(want) and got


def test_of_phrases_that_hold_each_other_the_surer_stays(spark):
    rows = [(1, "a b c d e", 3, 60), (1, "b c d e", 5, 70), (1, "a b c d", 4, 60), (1, "x a b c", 3, 60), (2, "a b c d e", 3, 60)]
    df = spark.createDataFrame(rows, "chat long, gram string, n long, confidence long")
    got = {(r["chat"], r["gram"]) for r in phrases.without_repeats(df, 4).collect()}
    # "a b c d e" is held off by the surer "b c d e", so "a b c d" stays.
    assert got == {(1, "b c d e"), (1, "a b c d"), (1, "x a b c"), (2, "a b c d e")}


def test_equal_rows_are_not_paired(spark):
    rows = [(i, "en", ["a b", "b c"] if i % 2 else ["b c", "a b"]) for i in range(3000)] + [(5000, "en", ["a b", "b c", "c d"]), (5001, "de", ["a b"]), (5002, "en", [])]
    start = time.time()
    got = {r["id"] for r in thinned(spark.createDataFrame(rows, "id long, family string, grams array<string>"), 50).collect() if r["kept"]}
    assert got == {0, 5001, 5002} and time.time() - start < 25


def test_each_broken_invariant_is_reported(spark):
    turns = spark.createDataFrame([(1, 1, "one two. three")], "chat_id long, pos long, content string")
    good = {
        "clauses": [(1, 1, 0, 7, "two"), (1, 1, 9, 14, None)], "episodes": [(1, 1, 2, 0, 5), (1, 2, 1, 6, 9)], "groups": [(3, 3), (4, 3)],
    }
    bad = {
        "clause_spans_overlap": ("clauses", [(1, 1, 0, 7, "two"), (1, 1, 5, 14, None)]), "fragment_outside_turn": ("clauses", [(1, 1, 0, 99, None)]), "object_not_in_clause": ("clauses", [(1, 1, 0, 7, "three")]),
        "episodes_overlap": ("episodes", [(1, 1, 2, 0, 5), (1, 2, 1, 4, 9)]), "episode_rows_lost": ("episodes", [(1, 1, 2, 0, 5)]), "root_not_smallest": ("groups", [(3, 4), (4, 4)]),
    }
    schemas = {"clauses": "chat_id long, pos long, start long, stop long, own string", "episodes": "chat_id long, episode long, n long, start_us long, end_us long", "groups": "id long, root long"}

    def counts(changed):
        t = {k: spark.createDataFrame(changed.get(k, v), schemas[k]) for k, v in good.items()}
        found = dialogue.invariant_counts(turns, t["clauses"], t["episodes"], spark.range(3), t["groups"])
        return {r["invariant"]: r["violations"] for r in found.collect() if r["violations"]}

    assert counts({}) == {}
    for name, (part, rows) in bad.items():
        assert name in counts({part: rows}), name
