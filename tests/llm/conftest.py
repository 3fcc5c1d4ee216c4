import random

import pytest
from pyspark.sql import functions as F

#: Columns of documents, and one that clashes with working or output columns of each operator.
CLASHES = ["_rid", "_n", "_key", "_cell", "shard", "SCORE", "n_tokens", "_found", "in0", "h", "node"]


def prose(rng, n, words=None):
    words = words or "the of and to in that was for with as on be at by this had not are but from".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "er", "ing", "tion", "s."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty, repeated, wordless and very long texts, and clashing columns."""
    rng = random.Random(3)
    base = prose(rng, 60)
    rows = [
        (1, base, "en", "a", 300),
        (2, base, "en", "b", 300),
        (3, base + " addendum", "en", None, None),
        (4, prose(rng, 80), None, "a", 5),
        (5, "", "en", "a", 0),
        (6, None, "en", "a", None),
        (None, None, None, None, None),
        (None, base, "fr", "b", 7),
        (7, "   \t\n ", "de", "c", 3),
        (8, "?!% 123 ...", "de", "c", 3),
        (9, "word", "en", "a", 4),
        (9, "word", "en", "a", 4),
        (10, prose(rng, 40_000), "en", "a", 200_000),
        (11, "x" * 300_000, "en", "d", 300_000),
    ]
    rows += [(100 + i, prose(rng, 50 + i % 7), "en", f"s{i % 4}", 250) for i in range(40)]
    rows += [(200 + i, prose(rng, 50, "le la de un des que é à étre pour dans sur".split()), "fr", "f", 250) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    """The same columns, no rows."""
    return odd.limit(0)
