import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(texts):
    """Rows of documents with extra columns whose names clash with those of results."""
    return [(i, t, "en", "s", len(t or ""), "x", 0.5) for i, t in texts]


@pytest.fixture()
def frame(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture()
def odd_texts():
    """Null, empty, white space, one word, very long, unusual characters, repeated rows."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    return [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, long), (5, "x" * 60_000), (6, "ünï cödé 日本語 \x00 \U0001f600 ▁▁  "), (7, long), (8, "a b c d e"), (8, "a b c d e"), (9, "No. 1\n\nNo. 1\n\nNo. 1")]
