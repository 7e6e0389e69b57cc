import hashlib
import random
import zlib

import pytest

from parley.llm.periodic_runs import LEAST, periodic_runs, run_digests, runs_of, with_repeated_tails


def plain_runs(words):
    """All maximal stretches of each period, the smallest period of a stretch first."""
    found, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        b = 0
        while b + q < len(words):
            e = b
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e + q - b >= max(LEAST, 2 * q) and (b, e + q) not in seen:
                seen.add((b, e + q))
                found.append((b, e + q, q))
            b = max(e, b) + 1
    return sorted(found)


def found_runs(texts):
    runs, starts = runs_of([[str(w).encode() for w in t] for t in texts])
    out = [[] for _ in texts]
    for b, e, q in runs.tolist():
        k = max(i for i, s in enumerate(starts[:-1]) if s <= b)
        out[k].append((b - int(starts[k]), e - int(starts[k]), q))
    return out


def glued(rng):
    """Two periodic regions of one root that meet out of phase, within other words."""
    root = [rng.randrange(3) for _ in range(rng.randint(2, 5))]
    left, right = root * rng.randint(3, 40), root * rng.randint(3, 40)
    return [9, *left[rng.randrange(3) :], *right[rng.randrange(len(root)) :], 8] * rng.randint(1, 3)


def nested(rng):
    text = [rng.randrange(4) for _ in range(rng.randint(1, 5))]
    while len(text) < 300:
        text = text * rng.randint(2, 4) + [rng.randrange(4) for _ in range(rng.randint(0, 3))]
    return text


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_plain_search(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(k) for _ in range(rng.randint(0, 150))] for k in (1, 2, 2, 3, 5) for _ in range(8)]
    texts += [glued(rng) for _ in range(12)] + [nested(rng) for _ in range(3)] + [fibonacci(rng.randint(10, 400))]
    texts += [[rng.randrange(50) for _ in range(rng.randint(0, 20))] + [rng.randrange(30) for _ in range(p)] * 3 for p in (7, 40, 90)]
    rng.shuffle(texts)
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_thue_morse_and_long_glued_regions():
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    ab = [0, 1] * 150 + [1, 0] * 150
    assert found_runs([morse, ab]) == [plain_runs(morse), plain_runs(ab)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    hit = {i for b, e, q in runs for i in range(b + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    lines = "".join(f"{b},{e - b},{q}\n" for b, e, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in hit)
    head = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_plain_search(frame):
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{rng.randrange(k)}" for _ in range(rng.randint(0, 200)))) for i, k in enumerate([2, 3, 9, 400] * 30)]
    texts += [(1000, None), (1001, ""), (1002, " \n\t\x0b "), (1003, "one"), (1004, "日本 語  x " * 9), (1004, "日本 語  x " * 9), (1005, "a b c\n" * 40)]
    got = run_digests(periodic_runs(with_repeated_tails(frame(texts)))).collect()
    assert sorted(map(tuple, got)) == sorted(expected(*t) for t in texts)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts) > 5


def test_odd_rows_and_empty_tables(frame, odd_texts):
    got = {r.doc_id: r for r in run_digests(periodic_runs(with_repeated_tails(frame(odd_texts)))).collect()}
    assert got[0].collapsed_sha256 == hashlib.sha256(b"").hexdigest() and got[0].n_runs == 0
    assert got[4].collapsed_sha256 is not None
    assert run_digests(periodic_runs(with_repeated_tails(frame([])))).count() == 0
    assert periodic_runs(with_repeated_tails(frame([(None, "a b " * 9)]))).collect()[0].collapsed == "a b"
