"""Small tables with everything that real ones have: nulls, empty texts, repeats, long texts, clashing columns."""

import random

import pytest

# Columns that operators use themselves; here they belong to the input.
CLASHING = ("digest", "fp", "key", "kept", "slot", "shard", "words", "window", "hash", "spans", "score", "count", "n", "root", "node", "file")


@pytest.fixture(scope="session")
def prose():
    """A text of invented words."""
    def make(seed: int, n: int, vocabulary: int = 3000) -> str:
        rng = random.Random(seed)
        return " ".join(f"{rng.choice('abcdefg')}o{rng.randrange(vocabulary)}x" for _ in range(n))
    return make


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs, with other columns whose names clash."""
    def make(pairs, lang="en", source="src"):
        rows = [(i, t, lang, source, None if t is None else len(t), *CLASHING) for i, t in pairs]
        names = ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    return make


@pytest.fixture(scope="session")
def odd_pairs(prose):
    """Null and empty texts, null and repeated ids, rows repeated whole, ties, a long text."""
    long = prose(1, 30_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "One two three"), (4, "One two three"), (5, "One two three"), (None, "One two three"),
        (None, None), (6, long), (7, long + " end"), (8, "Été ß Σ 中文 😀 one"), (9, "x"), (9, "y"), (10, prose(2, 50)), (11, prose(2, 50)),
    ]
