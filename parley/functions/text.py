"""Rules over message texts as column expressions. A profile is data: word classes and weights;
the expressions are built from it, so every language's profile runs through the same plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Redaction patterns in the order in which they apply. Portable to other regex engines.
REDACTIONS = (
    ("[KEY]", "\\b(?:sk|api|key)-[A-Za-z0-9_-]{12,}"),
    ("[PATH]", "(?:/[A-Za-z0-9._-]+){3,}"),
    ("[MD5]", "\\b[0-9a-f]{32}\\b"),
    ("[EMAIL]", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"),
    ("[PHONE]", "\\+[0-9][0-9 ().-]{7,18}[0-9]"),
)


@dataclass(frozen=True)
class Profile:
    """Word classes by weight, for the scoring of messages."""

    weights: dict[str, tuple[str, int]] = field(default_factory=dict)  # name -> (pattern, points)
    decision_only: str = "(?i)^[^a-z]*(?:yes|no|ok)[^a-z]*$"
    greeting: str = "(?i)^(?:hi|hello|hey|good (?:morning|evening))[ !.,]*$"
    acknowledgement: str = "(?i)^(?:ok|okay|thanks|thank you|got it|sure)[ !.,]*$"
    media: str = "^\\[(?:image|voice|video|file)[^\\]]*\\]$"


#: For the invented prose of the test tables.
TEST_PROFILE = Profile(
    weights={
        "action": ("(?i)(?:^|[^a-z])(?:with|avec|por|mit)(?:[^a-z]|$)", 42),
        "risk": ("(?i)(?:^|[^a-z])(?:was|pour|para|der)(?:[^a-z]|$)", 32),
        "trade": ("(?i)(?:^|[^a-z])(?:for|sur|con|und)(?:[^a-z]|$)", 20),
        "link": ("[0-9]{3,}", 8),
        "question": ("[?]|%%%", 25),
    }
)


def redact(text: Column) -> Column:
    """The redactions as one expression; ``redacted`` is for whole columns."""
    for name, pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, name)
    return text


#: What a text has at least where a pattern could match: a search for it spares most texts the pattern.
MARKS = {"[KEY]": "-", "[PATH]": "/", "[EMAIL]": "@", "[PHONE]": "+"}


def redacted(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the redactions applied to a column, one projection for each, so that none is copied into the next."""
    for name, pattern in REDACTIONS:
        clean = F.regexp_replace(text, pattern, name)
        rows = rows.withColumn(text, F.when(F.contains(text, F.lit(MARKS[name])), clean).otherwise(F.col(text)) if name in MARKS else clean)
    return rows


def clip(text: Column, limit: int) -> Column:
    trimmed = F.trim(text)
    return F.when(F.length(trimmed) > limit, F.concat(F.substring(trimmed, 1, limit - 1), F.lit("…"))).otherwise(trimmed)


def classes_met(text: Column, profile: Profile) -> Column:
    """Names of the classes that a text meets, sorted: each pattern is tried once, and score and reasons follow."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, (p, _) in sorted(profile.weights.items())]))


def message_score(text: Column, profile: Profile, met: Column | None = None) -> Column:
    """0 to 100: 10 for 24 characters or more, and the points of every class that is met (by ``met``, where that is known)."""
    total = F.when(F.length(text) >= 24, 10).otherwise(0)
    for name, (pattern, points) in profile.weights.items():
        total = total + F.when(text.rlike(pattern) if met is None else F.array_contains(met, name), points).otherwise(0)
    return F.when(text.rlike(profile.decision_only), F.least(total, F.lit(24))).otherwise(F.least(total, F.lit(100)))


def score_level(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 28, "medium").when(score > 0, "low").otherwise("excluded")


def recognition(text: Column, profile: Profile) -> Column:
    """First class that fits."""
    bare = F.regexp_replace(text, "[\\s\\p{Punct}]", "")
    return (
        F.when(text.rlike(profile.media), "media").when(bare == "", "reaction").when(text.rlike(profile.greeting), "greeting")
        .when(text.rlike(profile.acknowledgement), "acknowledgement").when(F.length(text) < 24, "context_fragment").when(F.length(bare) < 40, "low_information").otherwise("none")
    )


def terms(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words of a-z of at least that length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))


def meme_signature(text: Column) -> Column:
    """Text without links, placeholders and anything but letters and digits; null unless 3 to 36 long."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "https?://\\S+", ""), "\\[[a-z]+\\]", ""), "[^a-z0-9]", "")
    return F.when(F.length(bare).between(3, 36), bare)


def stable_id(kind: str, *parts: Column) -> Column:
    """20 hex digits of a hash over the parts, nulls told apart from empty ones."""
    told = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *told), 256), 1, 20)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Clamped to -1 .. 1; 0 for empty vectors, vectors of unequal length or without a norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size)))
