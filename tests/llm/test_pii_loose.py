"""Loose forms of personal data are found where a corpus holds base forms in like contexts."""

import hashlib
import math
import random
import time

import numpy as np

from parley.llm import pii


def corpus(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(300):
        texts.append((3 * i, f"note {i}: please call +1 {rng.randrange(200, 999)} {digits(3)} {digits(4)} before noon"))
        texts.append((3 * i + 1, f"the mail is person{i}@host{i % 7}.example.org for replies {i}"))
        texts.append((3 * i + 2, f"part {digits(4)}-{digits(4)} of lot {digits(9)} was look (at) this. Then {i}"))
    return texts


def test_loose_forms_are_found(frame):
    texts = corpus(random.Random(4))
    model = pii.fit(frame(texts))
    found = lambda t: [t[s:e] for s, _, e in model.select(t, pii.base_spans(t))]
    assert found("the mail is jane (at) host3 (dot) example (dot) org for replies") == ["jane (at) host3 (dot) example (dot) org"]
    assert found("please call (212) 555-0187 before noon") == ["(212) 555-0187"]
    assert found("please call 0044 20 7946 0958 before noon") == ["0044 20 7946 0958"]
    assert found("part 1234-5678 of lot 123456789 was") == []


def test_verdicts_of_loose_spans():
    assert pii.normal("email", "jane (at) host (dot) org") and not pii.normal("email", "look (at) this. Then")
    assert pii.normal("ip", "10-0-0-1") and not pii.normal("ip", "10-0-0-999")
    assert pii.normal("card", "4111.1111.1111.1111") and not pii.normal("card", "4111.1111.1111.1112")
    assert pii.normal("phone", "(212) 555-0187") and not pii.normal("phone", "12-34-56")


def test_secrets_are_found(frame):
    """Secrets by format and context: also where no telling name stands before them."""
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [(i, f'note {i} token = "{hexes(40)}" end') for i in range(200)]
    texts += [(1000 + i, f"see part-number-{i}-of-the-long-list-{i % 7} and mail person{i}@host.example.org") for i in range(200)]
    model = pii.fit(frame(texts))
    rows = {r["doc_id"]: r for r in pii.detect(frame(texts), model).collect()}
    assert all(rows[i]["n_secret"] == 1 for i in range(200)) and not any(rows[1000 + i]["n_secret"] for i in range(200))
    text = f'x = "{hexes(40)}" y'
    assert [text[s:e] for s, _, e in model.select(text, pii.base_spans(text))] == [text[5:45]]
    assert pii.redact(text, model.select(text, pii.base_spans(text))) == 'x = "[SECRET]" y'


def mixed_corpus(rng, n):
    """Texts with personal data, their spans, and as many look-alikes, none of a shape or word list of the planted examples."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(3, 30)))
    right = [
        lambda: ("", f"{word()}{digits(2)} (at) {word()} (dot) org"), lambda: ("", f"{word()}[at]{word()}.net"), lambda: ("password=", hexes(32)), lambda: ('client_secret: "', hexes(40)),
        lambda: ("please call ", f"({digits(3)}) {digits(3)}-{digits(4)}"), lambda: ("api key: ", "sk_live_" + hexes(12) + "AB12cd34"), lambda: ("server ip ", "-".join(str(rng.randint(1, 250)) for _ in range(4))),
    ]
    wrong = [
        lambda: ("commit ", hexes(40)), lambda: ("sha256: ", hexes(64)), lambda: ("/docs/releases/", f"{rng.randint(1990, 2030)}-notes-for-version{digits(2)}-final"), lambda: ("version ", ".".join(digits(1) for _ in range(4)) + ".1"),
        lambda: ("", f"{word()} (at) {word()}, then {word()}"), lambda: ("order ", digits(11)), lambda: ("", f"20{digits(2)}-0{digits(1)[:1]}-1{digits(1)} 1{digits(1)}:30"), lambda: ("", f"{word()}-{word()}-{word()}-{digits(3)}-{word()}-list"),
    ]
    out = []
    for i in range(n):
        (before, form), good = (rng.choice(right)(), True) if i % 2 else (rng.choice(wrong)(), False)
        left = prose() + " " + before
        out.append((left + form + ("" if not before.endswith('"') else '"') + " " + prose(), (len(left), len(left) + len(form)), good))
    return out


def test_selected_spans_of_a_mixed_corpus(frame):
    rng = random.Random(12)
    model = pii.fit(frame([(i, t) for i, (t, _, _) in enumerate(mixed_corpus(rng, 400))]))
    assert any(f >= pii.FORMAT for t in model.trees.values() for f in t.used())
    found = right = caught = wanted = 0
    for text, span, good in mixed_corpus(rng, 600):
        base = pii.base_spans(text)
        spans = [(s, e) for s, _, e in model.select(text, base)]
        found += len(spans)
        right += good and span in spans
        wanted += good
        caught += good and any(s < span[1] and span[0] < e for s, e in spans)
    assert right / found >= 0.95 and caught / wanted >= 0.85, (right, found, caught, wanted)


def test_look_alikes_stay(frame):
    model = pii.fit(frame([(i, t) for i, (t, _, _) in enumerate(mixed_corpus(random.Random(3), 300))]))
    found = lambda t: [t[s:e] for s, _, e in model.select(t, pii.base_spans(t))]
    digest = "3f9ab2c4d5e6f708192a3b4c5d6e7f8091a2b3c4"
    assert found(f"see commit {digest} for it") == [] and found("at /docs/releases/2024-notes-for-version10-final you find") == []
    assert found(f"checksum = {digest} end") == [] and found("on 2024-05-06 12:30 we met, look (at) this. Then") == []
    assert found("mail anna (at) example (dot) org today") == ["anna (at) example (dot) org"]
    assert found(f'auth_token = "{digest}" end') == [digest]
    kinds = [pii.KINDS[k] for _, k, _ in model.select("pay with 4111.1111.1111.1111 now", [])]
    assert kinds == ["card"]


def plain_choice(scored, thresholds):
    kept = []
    for _, s, _, k, e in sorted((-q, s, s - e, k, e) for q, s, k, e in scored if q >= thresholds[k]):
        if all(e <= a or b <= s for a, _, b in kept):
            kept.append((s, k, e))
    return sorted(kept)


def test_choice_of_spans_equals_all_pairs(monkeypatch):
    rng = random.Random(2)
    for _ in range(200):
        scored = [(rng.randint(0, 6) / 6, s, rng.randrange(5), s + rng.randint(1, 9)) for s in (rng.randrange(40) for _ in range(rng.randint(0, 25)))]
        model = pii.SpanModel({}, {k: rng.choice([0.3, 0.6]) for k in range(5)})
        monkeypatch.setattr(pii.SpanModel, "scored", lambda self, text, base, scored=scored: scored)
        assert model.select("", []) == plain_choice(scored, model.thresholds)


def test_features_count():
    f = pii.features("the token = 'abc123def4567890' end", 13, 29)
    assert len(f) > pii.FORMAT and all(isinstance(float(x), float) for x in f)
    assert f[pii.FORMAT] and not pii.features("the thing = 'abc123def4567890' end", 13, 29)[pii.FORMAT]


def test_a_text_full_of_spans_takes_seconds(frame):
    rng = random.Random(1)
    log = " ".join(f"host 10-0-{i % 250}-7 user{i}@mail.example.org look{i} (at) x (dot) org" for i in range(16_000))
    model = pii.fit(frame([(i, t) for i, (t, _, _) in enumerate(mixed_corpus(rng, 100))]), rounds=400)
    start = time.time()
    base = pii.base_spans(log)
    assert len(base) == 16_000
    model.select(log, base)
    assert len(log) > 1_000_000 and time.time() - start < 40


def test_every_document_is_learned_from(frame, monkeypatch):
    """Look-alikes of more documents than any sample took are all counted."""
    monkeypatch.setattr(pii, "COPIES", 10**6)
    monkeypatch.setattr(pii, "TREES", 1)
    texts = [(i, f"{i} at 300-7-9-{i % 10}") for i in range(24_000)]
    model = pii.fit(frame(texts))
    wrong = sum(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 3 > 0 for _, t in texts)
    right = 24_000 / 20_000 * 1_500 / 2 * 2 / 3  # of plants: every other is right, two in three are not kept back
    assert wrong > 15_000 and math.exp(model.trees[1].start) < 1.2 * right / wrong


def test_trees_do_not_depend_on_how_candidates_are_dealt(frame, monkeypatch):
    """Levels counted by jobs give the trees and thresholds that the driver's counts give."""
    monkeypatch.setattr(pii, "TREES", 5)
    monkeypatch.setattr(pii, "KEPT_TREES", 2)
    docs = frame([(i, t) for i, (t, _, _) in enumerate(mixed_corpus(random.Random(5), 120))])
    want = pii.fit(docs, rounds=300)
    monkeypatch.setattr(pii, "AT_HAND", 0)
    got = pii.fit(docs.repartition(7), rounds=300)
    assert len(want.trees) == 5 and want.thresholds and got.thresholds == want.thresholds
    assert {k: t.trees for k, t in got.trees.items()} == {k: t.trees for k, t in want.trees.items()}


def test_blocks_without_rows_of_open_nodes_are_summed():
    """A first block that has no rows in the open nodes of its kind takes nothing from the others."""
    trees = pii.Trees.begun([[0.5]], 2, 4)
    trees.trees, trees.open = [[(0, 0, 1, 2), 0.1, 0.2]], [2]
    blocks = [(0, np.full((3, 1), bins, np.uint8), np.array([True, False, False]), np.ones(3), np.zeros(3)) for bins in (0, 1, 1)]
    (g, h), (g1, h1) = (pii.sums({0: trees}, part)[0, 2] for part in (blocks, blocks[1:2]))
    assert np.allclose(g, 2 * g1) and np.allclose(h, 2 * h1) and h[0, 1] > 0
