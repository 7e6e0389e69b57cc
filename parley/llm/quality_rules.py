"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes a document good (1), bad (-1) or abstains (0). A rule that looks for a defect
abstains where it finds none: that says little about the rest. Two rules vote good, each for one
narrow band: ``prose`` if all statistics are those of running text, ``sentences`` if sentences end
as often as they do there. Expectation maximisation over the counts of vote patterns (at most 3 to the number of
rules, whatever the input) estimates how often each rule votes which way, abstaining included, on
good and on bad documents, and the posterior probability that a document is good replaces the
demand that it pass every rule.

Words are runs of characters other than space and U+0009 to U+000D. Defined cases: a null text
has no words, symbols or lines; a text without words fails the base rules (n_words < 50).
Repeated rows are judged each; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import staged

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_LETTERS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
KEEP = 0.5
ROUNDS = 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_ends", "n_other")
#: Low bits of a window's key that hold its start; those above hold bits of its hash.
START_BITS = 31


def word_list(text: Column) -> Column:
    """Words, split without a character class: regular expressions with several of these at once slow each other down."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _counted(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def window_keys(words: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """A sorted number for each 3-word window: bits of its hash, then its start. Numbers sort without a comparison that Spark
    would interpret, and windows of equal text stand together."""
    of = lambda w, i: hashed(w, F.get(words, i + 1), F.get(words, i + 2))
    return F.sort_array(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: of(w, i).bitwiseAND(F.lit(-(1 << START_BITS))).bitwiseOR(i.cast("long"))))


def repeat_candidates(keys: Column, words: Column) -> Column:
    """Sorted structs (w, i) of text and start of the windows that share the bits of their hash with another: all windows that
    occur twice or more, and by chance some that do not."""
    bits = lambda key: F.shiftright(key, START_BITS)
    same = lambda key, k: F.coalesce(bits(key) == bits(F.get(keys, k)), F.lit(False))
    starts = F.transform(F.filter(keys, lambda key, k: same(key, k - 1) | same(key, k + 1)), lambda key: key.bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int"))
    return F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))


def repeated_words(windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. ``windows``: sorted structs (w, i) of
    window text and start, all those of a text that occurs twice among them."""
    size = F.size(windows)
    at = F.sequence(F.lit(1), size)
    same = lambda k: F.element_at(windows, k)["w"] == F.element_at(windows, k + 1)["w"]
    starts = F.sort_array(F.transform(F.filter(at, lambda k: F.coalesce((k > 1) & same(k - 1), F.lit(False)) | F.coalesce((k < size) & same(k), F.lit(False))), lambda k: F.element_at(windows, k)["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"), s.alias("last")))
    return F.when(size < 2, F.lit(0).cast("long")).otherwise(covered["n"])


def statistics(docs: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """doc_id and STATISTICS of every document, without a shuffle. No statistic depends on ``hashed``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    # What is neither a letter of a-z nor white space, a small part of a text, is what most counts need; capitals are
    # counted on the way to it.
    capitals = F.translate("text", UPPER.lower() + SPACES, "")
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", word_list(F.col("text")).alias("words"), lines.alias("lines"), capitals.alias("capitals"))
    rows = rows.select("doc_id", "words", "lines", "capitals", F.translate("capitals", UPPER, "").alias("rest"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _counted(F.col("rest"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.length("capitals") - F.length("rest")).cast("long").alias("n_upper"),
        _counted(F.col("rest"), "!?").alias("n_marks"),
        _counted(F.col("rest"), ".!?").alias("n_ends"),
        _counted(F.col("rest"), NO_LETTERS).alias("n_other"),
        "words",
        window_keys(F.col("words"), hashed).alias("keys"),
    )
    counted = [c for c in STATISTICS if c != "n_repeat_words"]
    rows = rows.select("doc_id", *counted, repeat_candidates(F.col("keys"), F.col("words")).alias("windows"))
    return rows.select("doc_id", *counted, repeated_words(F.col("windows")).alias("n_repeat_words")).select("doc_id", *STATISTICS)


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def votes() -> dict[str, Column]:
    """The rules: 1 good, -1 bad, 0 abstains."""
    n = F.col("n_words")
    mean, lines = _ratio("word_chars", "n_words"), _ratio("n_dup_lines", "n_lines")
    upper, other = _ratio("n_upper", "word_chars"), _ratio("n_other", "word_chars")
    symbols, marks, ends, repeats, variety = (_ratio(c, "n_words") for c in ("n_symbols", "n_marks", "n_ends", "n_repeat_words", "n_distinct"))
    defect = lambda bad: F.when(bad, -1).otherwise(0)
    varied = (variety >= 0.3) | (F.col("n_distinct") >= 300)
    prose = (n >= 50) & mean.between(3, 10) & (symbols <= 0.02) & (other <= 0.08) & (marks <= 0.05) & (upper <= 0.12) & (lines <= 0.2) & (repeats <= 0.15) & varied
    return {
        "length": defect(n < 50),
        "word_length": defect((mean < 2.5) | (mean > 12)),
        "symbols": defect(symbols > 0.1),
        "letters": defect(other > 0.12),
        "marks": defect(marks > 0.1),
        "upper": defect(upper > 0.3),
        "lines": defect(lines > 0.3),
        "repeats": defect(repeats > 0.2),
        "variety": defect((n >= 50) & ~varied & (variety < 0.15)),
        "prose": F.when(prose, 1).otherwise(0),
        "sentences": F.when((ends < 0.002) | (ends > 0.5), -1).when(ends.between(0.02, 0.25), 1).otherwise(0),
    }


@dataclass
class LabelModel:
    prior: float
    #: For each rule the probability of each vote given bad and given good.
    tables: dict[str, dict[int, tuple[float, float]]]

    def log_odds(self) -> Column:
        """Log-odds that a document with columns named like the rules is good."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, table in self.tables.items():
            part = F.lit(0.0)
            for value, (bad, good) in table.items():
                part = F.when(F.col(rule) == value, F.lit(math.log(good / bad))).otherwise(part)
            total = total + part
        return total


#: What rules are held to by a share PRIOR_SHARE of all documents: votes (bad, none, good) of the bad
#: and the good among these, and how many of them are good. It makes a rule better than chance
#: and is as strong at every size.
START = {0: {-1: 0.25, 0: 0.625, 1: 0.125}, 1: {-1: 0.05, 0: 0.45, 1: 0.5}}
PRIOR_SHARE, START_GOOD = 0.01, 0.8


def fit(voted: DataFrame, rules: list[str], rounds: int = ROUNDS) -> LabelModel:
    """EM for two classes and rules independent given the class, on the counts of vote patterns."""
    patterns = [(tuple(r[c] for c in rules), r["n"]) for r in voted.groupBy(*rules).agg(F.count("*").alias("n")).orderBy(*rules).collect()]
    return expectation_maximisation(patterns, rules, rounds)


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rules: list[str], rounds: int) -> LabelModel:
    """The likelier of two solutions: started from the votes' prior, and from the documents that no rule
    votes bad as the good ones."""
    held = max(4.0, PRIOR_SHARE * sum(n for _, n in patterns))
    cast = {r: sorted({p[i] for p, _ in patterns} | {0}) for i, r in enumerate(rules)}  # a vote that is never cast has no share

    def maximised(goods: list[float]) -> LabelModel:
        sums = {r: {v: [held * START[k][v] for k in (0, 1)] for v in cast[r]} for r in rules}
        for (pattern, n), good in zip(patterns, goods):
            for r, v in zip(rules, pattern):
                sums[r][v][0] += n * (1 - good)
                sums[r][v][1] += n * good
        by = {r: [sum(x[k] for x in table.values()) for k in (0, 1)] for r, table in sums.items()}
        tables = {r: {v: tuple(min(max(x[k] / by[r][k], 1e-5), 1.0) for k in (0, 1)) for v, x in table.items()} for r, table in sums.items()}
        good_sum = sum(n * g for (_, n), g in zip(patterns, goods)) + START_GOOD * held
        total = sum(n for (_, n), _ in zip(patterns, goods)) + held
        return LabelModel(min(max(good_sum / total, 1e-3), 1 - 1e-3), tables)

    def expected(model: LabelModel) -> tuple[list[float], float]:
        """Posteriors of the patterns, and the logarithm of what is maximised."""
        goods = []
        fit = held * (START_GOOD * math.log(model.prior) + (1 - START_GOOD) * math.log(1 - model.prior))
        fit += sum(held * START[k][v] * math.log(p) for table in model.tables.values() for v, both in table.items() for k, p in enumerate(both))
        for pattern, n in patterns:
            logs = [math.log(share) + sum(math.log(model.tables[r][v][k]) for r, v in zip(rules, pattern)) for k, share in ((0, 1 - model.prior), (1, model.prior))]
            goods.append(1 / (1 + math.exp(-max(min(logs[1] - logs[0], 700), -700))))
            fit += n * (max(logs) + math.log1p(math.exp(-abs(logs[1] - logs[0]))))
        return goods, fit

    found = []
    for model in (maximised([]), maximised([0.1 if -1 in p else 0.9 for p, _ in patterns])):
        for _ in range(rounds if patterns else 0):
            model = maximised(expected(model)[0])
        found.append((expected(model)[1], model))
    return max(found, key=lambda x: x[0])[1]


def quality_rules(docs: DataFrame) -> DataFrame:
    """Contract columns, and ``probability``, the posterior that a document is good."""
    rules = votes()
    voted = staged(statistics(docs).withColumns({r: v.cast("tinyint") for r, v in rules.items()}), "quality-rules")
    model = fit(voted, list(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.withColumn("probability", 1 / (1 + F.exp(-model.log_odds()))).withColumn("base_failed", failed)
    return scored.select("doc_id", *STATISTICS[:5], "base_failed", (~F.col("base_failed") & (F.col("probability") >= KEEP)).alias("kept"), "probability")
