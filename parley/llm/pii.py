"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap: the strict formats of the contract
(base spans, always kept) and looser ones. Boosted trees, some for each kind, score every candidate
that is no base span by features of its format and of its context; a threshold for each kind,
calibrated on candidates kept back, selects further redactions, best first where they overlap.

There are no labels, so personal data and look-alikes of many shapes (``pii_examples``) are planted
between the words of sampled texts. What is planted is known: each candidate that touches a plant is
right if it is the planted span of the planted kind, and wrong otherwise, so the candidates that
compete for a span are judged together, as in selection. Base spans rewritten into loose forms where
they stand are right ones too, and found candidates that fail the strict validators when written
normally are wrong ones. Without a split on context in any of the trees nothing is selected.

Every document is learned from: the candidates of all texts count, and plants, ``ROUNDS`` of each kind, are as
many again with each ``ROUNDS_DOCS`` documents and dealt over all of them. Trees grow from counts: cuts are percentiles of all candidates, and a
level of the trees of all kinds takes one pass that sums gradients by node, feature and bin. Gradients are
whole multiples of 1 / ``UNIT``, so sums, and with them the trees, do not depend on how candidates are
dealt over tasks. At most ``AT_HAND`` distinct candidates are summed by the same function without a job a level.

Defined cases: a null text is empty and has no spans. Repeated rows give repeated results.
Without candidates of both verdicts nothing is learned and only base spans come out. Ties
between overlapping candidates go to the earlier and then the longer one. A secret may hold a base
span, other added spans touch none. Only ``doc_id`` and
``text`` are read. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import pii_examples as examples
from parley.llm.common import Workspace, filled, workspace

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The base formats of the contract.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Looser generators. They may run into each other; the trees and the overlap rule decide.
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,63})+", re.A),
    "ip": re.compile(r"[0-9]{1,3}(?:[.,:-][0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ ./-]?[0-9]){11,18}"),
    "phone": re.compile(r"(?:\+|00|\()?[0-9][0-9() ./-]{5,20}[0-9]"),
}
SECRET_RUN = "[A-Za-z0-9+/_-]"
LOOSE["secret"] = re.compile(f"(?<!{SECRET_RUN})(?=[^0-9]{{0,199}}[0-9])(?=[^A-Za-z]{{0,199}}[A-Za-z]){SECRET_RUN}{{16,200}}(?!{SECRET_RUN})")
DIGIT = re.compile(r"[0-9]")
CONTEXT = 40
ROUNDS, ROUNDS_DOCS = 1_500, 20_000
TREES, DEPTH, RATE, BINS = 40, 4, 0.25, 16
PRECISION = 0.98
#: Gradients are multiples of 1 / UNIT, scores of the candidates kept back are compared by 1 / LEVELS.
UNIT, LEVELS = 1 << 20, 10_000
#: Copies of one candidate that count: more say little more.
COPIES = 8
#: Candidates a block of binned ones; how many are gathered before they are counted or binned; the most that the driver holds (some 30 MB).
BLOCK, GATHERED, AT_HAND = 1_000, 20_000, 400_000
#: Trees after which scores are written anew, so that a pass adds up few of them.
KEPT_TREES = 8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """Whether a match of a base format counts."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    if kind == "card":
        digits = found.replace(" ", "").replace("-", "")
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(DIGIT.findall(found)) <= 15
    return True


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def base_matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of a base format, in time linear in the text: plain searches
    for addresses would start over at every character of a long run."""
    if kind == "email":
        free, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            free = m.end() if m else at + 1
            if m:
                yield start, m.end()
            at = text.find("@", free)
    elif kind == "ip":
        for m in DOTTED.finditer(text):
            parts = m.group().split(".")
            at = m.start()
            for i in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[i : i + 4])) + 3
                yield at, at + size
                at += size + 1
    else:
        yield from ((m.start(), m.end()) for m in BASE[kind].finditer(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end), sorted."""
    return sorted((a, k, b) for k, kind in enumerate(BASE_KINDS) for a, b in base_matches(kind, text) if valid(kind, text[a:b]))


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def cue(words: tuple[str, ...], near: bool = False) -> re.Pattern:
    """Words that stand right before a span, with what may come between, or anywhere in the window."""
    found = "|".join(sorted(map(re.escape, words), key=len, reverse=True))
    return re.compile(rf"(?i)(?<![a-z])(?:{found})" + (r"(?![a-z])" if near else r"(?:\s(?:is|number|no\.?))?[^A-Za-z0-9]{0,5}$"))


CUES = [examples.SECRET_WORDS, examples.HASH_WORDS, examples.CONTACT_WORDS, examples.NETWORK_WORDS, examples.CARD_WORDS, examples.NUMBER_WORDS]
AT, NEAR = [cue(w) for w in CUES], [cue(w, near=True) for w in CUES]
ASSIGNED = re.compile(r"(?:[=:]|=>)\s{0,2}[\"']?$")
MARKED = re.compile(r"(?:[a-z]{2,5}(?:_[a-z]{2,5})?[_-]|[A-Z]{4}|AIza|eyJ)(?=[A-Za-z0-9]{8})")
NOT_SPACE = "".join(chr(c) for c in range(33, 127))
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Features of the format come first; those of the context follow.
FORMAT = 32


def features(text: str, start: int, end: int) -> list[float]:
    """What is seen of format and context."""
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    numbers, words = re.findall("[0-9]+", s), re.findall("[A-Za-z]+", s)
    n, joined = sum(map(len, numbers)), "".join(numbers)
    long_words = [w for w in words if len(w) >= 3 and (w[1:].islower() or w.isupper())]
    form = [
        len(s), n, n / len(s), len(numbers), max(map(len, numbers), default=0), min(map(len, numbers), default=0), len(set(joined)), len(words),
        max(map(len, words), default=0), sum(map(len, words)) / len(s), len(long_words), sum(map(len, long_words)) / len(s), sum(w.lower() in examples.SLUG_WORDS for w in words), entropy(s),
        s.count("."), s.count("-"), s.count(" "), s.count("_"), s.count("/"), s.count(":") + s.count(","), "@" in s, "(at)" in s or "[at]" in s,
        "(dot)" in s or "[dot]" in s, s[0] == "(", s[0] == "+", s[:2] == "00", s[-1].isalpha(), bool(HEX.fullmatch(s)), bool(MARKED.match(s)), s.lower() != s and s.upper() != s,
        luhn(joined) and 12 <= n <= 19, len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers),
    ]
    stuck = len(before) - len(before.rstrip(NOT_SPACE))
    context = [
        *(bool(c.search(before)) for c in AT), *(bool(c.search(before)) for c in NEAR), bool(ASSIGNED.search(before)), before[-1:] in ("\"", "'"), after[:1] in ("\"", "'"),
        before[-1:].isspace() or not before, after[:1].isspace() or not after, before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ("/", ".", "-", "_", "@", "#"), after[:1] in ("/", ".", "-", "_", "@"),
        stuck, "/" in before[len(before) - stuck :], "http" in before or "www" in before or "href" in before, len(DIGIT.findall(before[-12:])), len(DIGIT.findall(after[:12])),
    ]
    return form + context


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the loose generators and of failed base formats; only secrets may touch a base span."""
    if not DIGIT.search(text) and "@" not in text and "(at)" not in text and "[at]" not in text:
        return []
    found = set()
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text and "(at)" not in text and "[at]" not in text:
            continue
        found |= {(m.start(), k, m.end()) for m in LOOSE[kind].finditer(text)}
        if kind in ("ip", "card"):
            found |= {(a, k, b) for a, b in base_matches(kind, text)}
    starts = [s for s, _, _ in base]  # sorted; the furthest end so far tells whether one reaches a place
    ends: list[int] = []
    for _, _, e in base:
        ends.append(max(e, ends[-1]) if ends else e)

    def touches(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    return sorted(x for x in found if KINDS[x[1]] == "secret" or not touches(x[0], x[2]))


def normal(kind: str, found: str) -> bool:
    """Whether a loose span, written in the base format, counts."""
    if kind == "email":
        plain = re.sub(r"\s?(?:@|\(at\)|\[at\])\s?", "@", found)
        plain = re.sub(r"\s?(?:\(dot\)|\[dot\])\s?|\s\.\s", ".", plain)
        return bool(BASE["email"].fullmatch(plain))
    if kind == "ip":
        return valid(kind, re.sub(r"[,:-]", ".", found))
    return valid(kind, "".join(DIGIT.findall(found)))


def loosened(kind: str, found: str) -> list[str]:
    """A base span in the loose forms of its kind that need no context."""
    if kind == "email":
        return [found.replace("@", at).replace(".", dot) for at, dot in ((" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", "."))]
    number = "".join(DIGIT.findall(found))
    if kind == "card":
        return [x.join(number[i : i + 4] for i in range(0, len(number), 4)) for x in "./"]
    return [f"({number[-10:-7]}) {number[-7:-4]}-{number[-4:]}"] if kind == "phone" else []


def judged(text: str, start: int, end: int, kind: str | None) -> Iterator[tuple[int, bool, list[float]]]:
    """Kind, verdict and features of the candidates that touch what was planted in text[start:end]."""
    for s, k, e in candidates(text, base_spans(text)):
        if s < end and start < e:
            yield k, (s, KINDS[k], e) == (start, kind, end), features(text, s, e)


def planted(text: str, rng: random.Random) -> Iterator[tuple[int, bool, list[float]]]:
    for before, form, after, kind in examples.plants(rng):
        left, right = examples.place(rng, text, CONTEXT)
        yield from judged(left + before + form + after + right, len(left) + len(before), len(left) + len(before) + len(form), kind)


def seen(text: str) -> Iterator[tuple[int, bool, list[float]]]:
    """Base spans in loose forms where they stand, and candidates that no validator would pass."""
    base = base_spans(text)
    for s, k, e in base:
        before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
        for form in loosened(KINDS[k], text[s:e]):
            yield from judged(before + form + after, len(before), len(before) + len(form), KINDS[k])
    for s, k, e in candidates(text, base):
        if KINDS[k] != "secret" and not normal(KINDS[k], text[s:e]):
            yield k, False, features(text, s, e)


class Trees:
    """Gradient boosted regression trees on the logistic loss, over binned features. A node is a value, or (feature,
    last bin of the left side, left node, right node)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self._begin([np.quantile(c, QUANTILES) for c in x.T], int(y.sum()), len(y))
        boosted({0: self}, at_hand([(0, self.binned(x), y, np.ones(len(y)), np.full(len(y), self.start))]))

    @classmethod
    def begun(cls, cuts: list[np.ndarray], right: int, n: int) -> Trees:
        """No trees yet, for n candidates of which some are right, by quantiles of each feature."""
        trees = cls.__new__(cls)
        trees._begin(cuts, right, n)
        return trees

    def _begin(self, cuts: list[np.ndarray], right: int, n: int) -> None:
        self.cuts = [np.unique(c) for c in cuts]
        self.start = float(np.log((right + 1) / (n - right + 1)))
        self.trees: list[list] = []
        self.open: list[int] = []  # nodes of the last tree that may be split
        self.counted = 0  # trees that the scores of blocks hold already

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1).astype(np.uint8)

    def split(self, at: int, g: np.ndarray, h: np.ndarray) -> None:
        """Splits a node of the last tree where that gains, by sums of gradients and curvatures by feature and bin."""
        tree, gl, hl = self.trees[-1], np.cumsum(g, 1), np.cumsum(h, 1)
        gs, hs = gl[0, -1], hl[0, -1]
        tree[at] = RATE * gs / (hs + 1)
        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
        f, cut = map(int, np.unravel_index(gain.argmax(), gain.shape))
        if gain[f, cut] > 1e-6:
            left, right = len(tree), len(tree) + 1
            tree += [RATE * gl[f, cut] / (hl[f, cut] + 1), RATE * (gs - gl[f, cut]) / (hs - hl[f, cut] + 1)]
            tree[at] = (f, cut, left, right)
            self.open += [left, right]

    def places(self, tree: list, binned: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        out, stack = np.zeros(len(binned), np.int64), [(0, np.arange(len(binned)))]
        while stack:
            at, rows = stack.pop()
            if isinstance(tree[at], tuple):
                f, cut, a, b = tree[at]
                left = binned[rows, f] <= cut
                stack += [(a, rows[left]), (b, rows[~left])]
            else:
                out[rows] = at
        return out

    def added(self, score: np.ndarray, binned: np.ndarray, trees: list[list]) -> np.ndarray:
        """Scores and what trees, one after the other, say besides."""
        for tree in trees:
            values = np.array([0.0 if isinstance(node, tuple) else node for node in tree])
            score = score + values[self.places(tree, binned)]
        return score

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self.binned(x)
        return 1 / (1 + np.exp(-self.added(np.full(len(binned), self.start), binned, self.trees)))

    def used(self) -> set[int]:
        """Features that a split looks at."""
        return {node[0] for tree in self.trees for node in tree if isinstance(node, tuple)}


QUANTILES = [i / BINS for i in range(1, BINS)]

#: Kind, bins, verdicts, copies and scores of candidates.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Sums of gradients and of curvatures by feature and bin, for each kind and node.
Sums = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def sums(model: dict[int, Trees], blocks: Iterable[Block]) -> Sums:
    """Sums, in units, over the candidates of blocks in the open nodes of each kind's last tree."""
    out: Sums = {}
    for kind, binned, y, n, score in blocks:
        trees = model[kind]
        if not trees.open:
            continue
        p = 1 / (1 + np.exp(-trees.added(score, binned, trees.trees[trees.counted : -1])))
        width, nodes = binned.shape[1], np.array(trees.open)
        place = trees.places(trees.trees[-1], binned)
        at = np.searchsorted(nodes, place).clip(max=len(nodes) - 1)
        here = nodes[at] == place
        cell = ((at[here, None] * width + np.arange(width)) * BINS + binned[here]).ravel()
        # Of no rows bincount makes integers, whatever the weights.
        g, h = (np.bincount(cell, np.repeat((np.rint(v * UNIT) * n)[here], width), len(nodes) * width * BINS).astype(float) for v in (y - p, p * (1 - p)))
        for node, a, b in zip(trees.open, g.reshape(len(nodes), width, BINS), h.reshape(len(nodes), width, BINS)):
            if (kind, node) in out:
                out[kind, node][0][:] += a
                out[kind, node][1][:] += b
            else:
                out[kind, node] = a, b
    return out


def at_hand(blocks: list[Block]) -> Callable[[dict[int, Trees]], Sums]:
    """``sums`` over blocks in memory, whose scores take in each tree once."""

    def summed(model: dict[int, Trees]) -> Sums:
        blocks[:] = [(k, bins, y, n, model[k].added(score, bins, model[k].trees[model[k].counted : -1])) for k, bins, y, n, score in blocks]
        for trees in model.values():
            trees.counted = len(trees.trees) - 1
        return sums(model, blocks)

    return summed


def boosted(model: dict[int, Trees], summed: Callable[[dict[int, Trees]], Sums]) -> None:
    """Grows the trees of all kinds side by side, a level with each call of ``summed``."""
    for _ in range(TREES):
        for trees in model.values():
            trees.trees.append([0.0])
            trees.open = [0]
        for _ in range(DEPTH):
            found = summed(model) if any(trees.open for trees in model.values()) else {}
            for trees in model.values():
                trees.open = []
            for (kind, node), (g, h) in sorted(found.items(), key=lambda x: x[0]):
                model[kind].split(node, g / UNIT, h / UNIT)


class SpanModel:
    """Trees and a threshold for each kind that has them: half way between the lowest score at which
    PRECISION held on the candidates kept back and the next."""

    def __init__(self, trees: dict[int, Trees], thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def scored(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[float, int, int, int]]:
        """(score, start, kind, end) of the candidates of kinds that may be selected."""
        found = [x for x in candidates(text, base) if x[1] in self.thresholds]
        out = []
        for k in sorted({k for _, k, _ in found}):
            own = [(s, e) for s, kind, e in found if kind == k]
            p = self.trees[k].predict(np.array([features(text, s, e) for s, e in own], np.float32).astype(float))
            out += [(float(q), s, k, e) for q, (s, e) in zip(p, own)]
        return out

    def select(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The best of overlapping candidates that reach their threshold, as (start, kind, end)."""
        good = sorted((-q, s, s - e, k, e) for q, s, k, e in self.scored(text, base) if q >= self.thresholds[k]) if self.thresholds else []
        starts: list[int] = []  # of what is kept, sorted and apart
        kept: list[tuple[int, int, int]] = []
        for _, s, _, k, e in good:
            i = bisect.bisect_left(starts, e)
            if i == 0 or kept[i - 1][2] <= s:
                starts.insert(i, s)
                kept.insert(i, (s, k, e))
        return kept


def fit(docs: DataFrame, rounds: int = ROUNDS) -> SpanModel:
    with workspace(docs.sparkSession) as work:
        rows = work(labelled(docs, rounds), "candidates")
        of = {(r["kind"], r["held"]): r for r in rows.groupBy("kind", "held").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y").cast("int")).alias("right"), F.count("*").alias("size")).collect()}
        taught = [k for k in range(len(KINDS)) if (k, False) in of and (k, True) in of and 0 < of[k, False]["right"] < of[k, False]["n"]]
        if not taught:
            return SpanModel({}, {})
        cuts = quantiles(rows.where(~F.col("held") & F.col("kind").isin(taught)))
        model = {k: Trees.begun(cuts[k], of[k, False]["right"], of[k, False]["n"]) for k in taught}
        blocks = work(binned(rows.where(F.col("kind").isin(taught)), model), "blocks")
        work.drop(rows)
        grow(model, blocks, work, sum(of[k, False]["size"] for k in taught))
        thresholds = precise(model, blocks)
    if all(f < FORMAT for t in model.values() for f in t.used()):
        thresholds = {}
    return SpanModel(model, thresholds)


def labelled(docs: DataFrame, rounds: int) -> DataFrame:
    """held (kept back from the trees), kind, y, x (features), n (copies, COPIES at most) of the distinct candidates of all texts."""
    each = rounds / max(1, min(docs.count(), ROUNDS_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), filled(batch.column(1)).to_pylist()):
                mark = hashlib.md5(text.encode()).hexdigest()
                held = int(mark[:8], 16) % 3 == 0
                rows += [(held, k, y, np.array(x, np.float32).tobytes()) for k, y, x in seen(text)]
                rng = random.Random(f"{doc_id}:{mark}")
                for _ in range(int(each) + (rng.random() < each % 1)):
                    held = rng.random() < 1 / 3
                    rows += [(held, k, y, np.array(x, np.float32).tobytes()) for k, y, x in planted(text, rng)]
                if len(rows) >= GATHERED:
                    yield answers(rows)
                    rows = []
        if rows:
            yield answers(rows)

    def answers(rows: list[tuple]) -> pa.RecordBatch:
        types = pa.bool_(), pa.int32(), pa.bool_(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["held", "kind", "y", "x"])

    found = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("string")).mapInArrow(run, "held boolean, kind int, y boolean, x binary")
    return found.groupBy("held", "kind", "y", "x").agg(F.least(F.count("*"), F.lit(COPIES)).alias("n"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined until they have GATHERED rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def quantiles(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """Exact quantiles of every feature of each kind, from counts by value that tasks combine before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            kinds, n, x = column(table, "kind"), column(table, "n"), vectors(column(table, "x"))
            for k in np.unique(kinds):
                own = kinds == k
                for f in range(x.shape[1]):
                    values, at = np.unique(x[own, f], return_inverse=True)
                    counts = np.bincount(at, n[own]).astype(np.int64)
                    fixed = [pa.array(np.full(len(values), v, np.int32)) for v in (k, f)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(values), pa.array(counts)], names=["kind", "feature", "value", "n"])

    counts = rows.select("kind", "x", "n").mapInArrow(run, "kind int, feature int, value double, n long").groupBy("kind", "feature", "value").agg(F.sum("n").alias("n"))
    found = counts.groupBy("kind", "feature").agg(F.percentile("value", QUANTILES, F.col("n")).alias("cuts")).collect()
    cuts = {(r["kind"], r["feature"]): np.array(r["cuts"]) for r in found}
    width = 1 + max(f for _, f in cuts)
    return {k: [cuts[k, f] for f in range(width)] for k in {k for k, _ in cuts}}


#: Candidates of one kind, packed: verdicts and copies a byte each, bins a byte for each feature, scores as doubles.
PACKED = "kind int, held boolean, y binary, n binary, bins binary, score binary"


def packed(kind: int, held: bool, y: np.ndarray, n: np.ndarray, bins: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    types = pa.int32(), pa.bool_(), *[pa.binary()] * 4
    values = int(kind), bool(held), *(np.ascontiguousarray(v, t).tobytes() for v, t in zip((y, n, bins, score), (np.uint8, np.uint8, np.uint8, np.float64)))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["kind", "held", "y", "n", "bins", "score"])


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in ("kind", "y", "n", "bins", "score")}
            y, n, bins = (np.frombuffer(r[c], np.uint8) for c in ("y", "n", "bins"))
            yield r["kind"], bins.reshape(len(y), -1), y.astype(float), n.astype(float), np.frombuffer(r["score"], np.float64)


def binned(rows: DataFrame, model: dict[int, Trees]) -> DataFrame:
    """The candidates of kinds that have trees, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            kinds, held, y, n, x = *(column(table, c) for c in ("kind", "held", "y", "n")), vectors(column(table, "x"))
            for k in model:
                for back in (False, True):
                    own = np.flatnonzero((kinds == k) & (held == back))
                    for part in np.array_split(own, range(BLOCK, len(own), BLOCK)) if len(own) else ():
                        yield packed(k, back, y[part], n[part], model[k].binned(x[part]), np.full(len(part), model[k].start))

    return rows.mapInArrow(run, PACKED)


def grow(model: dict[int, Trees], blocks: DataFrame, work: Workspace, size: int) -> None:
    """Grows all trees on the blocks that are not kept back: as many as ``size`` candidates."""
    train = blocks.where("NOT held")
    if size <= AT_HAND:
        return boosted(model, at_hand(list(unpacked(train.toArrow().to_batches()))))
    names = [f"{v}{i}" for v in "gh" for i in range(BINS)]
    now = work(train, "scored")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, bins, y, n, score in unpacked(batches):
            yield packed(k, False, y, n, bins, model[k].added(score, bins, model[k].trees[model[k].counted : -1]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, node), (g, h) in sums(model, unpacked(batches)).items():
            width = len(g)
            fixed = [pa.array(np.full(width, v, np.int32)) for v in (k, node)] + [pa.array(np.arange(width, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(c.astype(np.int64)) for v in (g, h) for c in v.T)], names=["kind", "node", "feature", *names])

    def summed(model: dict[int, Trees]) -> Sums:
        nonlocal now
        if all(len(t.trees) - 1 - t.counted == KEPT_TREES for t in model.values()):
            before, now = now, work(now.mapInArrow(scored, PACKED), "scored")
            work.drop(before)
            for t in model.values():
                t.counted = len(t.trees) - 1
        found = now.mapInArrow(counted, "kind int, node int, feature int, " + ", ".join(f"{c} long" for c in names)).groupBy("kind", "node", "feature").agg(*[F.sum(c).alias(c) for c in names])
        out: Sums = {}
        for r in found.collect():  # at most DEPTH levels of nodes, features and bins: no more with larger tables
            if (r["kind"], r["node"]) not in out:
                out[r["kind"], r["node"]] = tuple(np.zeros((len(model[r["kind"]].cuts), BINS)) for _ in "gh")
            for side, start in zip(out[r["kind"], r["node"]], (3, 3 + BINS)):
                side[r["feature"]] = r[start : start + BINS]
        return out

    boosted(model, summed)


def precise(model: dict[int, Trees], blocks: DataFrame) -> dict[int, float]:
    """The threshold of each kind, from counts of the candidates kept back by score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, bins, y, n, score in unpacked(batches):
            p = 1 / (1 + np.exp(-model[k].added(score, bins, model[k].trees)))
            level = np.rint(p * LEVELS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), k, np.int32)), pa.array(level), pa.array(n.astype(np.int64)), pa.array((n * y).astype(np.int64))], names=["kind", "level", "n", "hits"])

    found = blocks.where("held").mapInArrow(run, "kind int, level int, n long, hits long").groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    thresholds = {}
    for k in model:
        levels = sorted(((r["level"], r["n"], r["hits"]) for r in found if r["kind"] == k), reverse=True)
        level, n, hits = (np.array(c, float) for c in zip(*levels))
        fine = np.flatnonzero(np.cumsum(hits) / np.cumsum(n) >= PRECISION)
        if len(fine):
            level = np.append(level, 0.0) / LEVELS
            thresholds[k] = max(0.5, float(level[fine[-1]] + level[fine[-1] + 1]) / 2)
    return thresholds


def vectors(rows: Iterable[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32) for x in rows]).astype(float)


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def detect(docs: DataFrame, model: SpanModel, with_text: bool = False) -> DataFrame:
    """doc_id, counts and hash of base spans, all spans, number of secrets; and the text with its spans
    redacted if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            counts, hashes, spans, secrets, texts = [], [], [], [], []
            for text in filled(batch.column(1)).to_pylist():
                base = base_spans(text)
                every = sorted(base + m.select(text, base))
                counts.append([sum(k == x[1] for x in base) for k in range(len(BASE_KINDS))])
                secrets.append(sum(KINDS[k] == "secret" for _, k, _ in every))
                hashes.append(hashlib.sha256(named(base).encode()).hexdigest())
                spans.append(named(every))
                if with_text:
                    texts.append(redact(text, every))
            columns = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE_KINDS))), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(secrets, pa.int64())]
            names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_secret"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long" + ", redacted string" * with_text
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, overlapping ones together, becomes the name of its first kind in brackets."""
    out, at, last = [], 0, -1
    for s, k, e in sorted(spans):
        if s < last:
            at = last = max(last, e)
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = last = e
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs, all columns, with the spans of every text redacted; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = []
            for text in batch.column(place).to_pylist():
                base = base_spans(text or "")
                texts.append(text and redact(text, base + m.select(text, base)))
            yield batch.set_column(place, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, schema)


def pii(docs: DataFrame, with_text: bool = False) -> DataFrame:
    return detect(docs, fit(docs), with_text)
