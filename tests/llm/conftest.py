from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor " * 30_000  # half a million characters

# Null and empty texts, null ids, repeated rows, ties, a very long text.
ODD_ROWS = [
    (1, None, "h1"), (2, "", "h1"), (None, "one two three", None), (None, "one two three", None),
    (3, "one two three", "h1"), (3, "one two three", "h1"), (4, LONG, "h2"), (5, " \n\t ", "h2"),
    (6, "token = abcdef0123456789abcdef012345", "h1"), (7, "é𝒳 naïve text, with Ünïcode", None),
]
CLASHES = ["row", "size", "shard", "slot", "idx", "k1", "k2", "kept", "host", "hash", "fp", "root", "place", "n_words",
           "kinds", "found", "hits", "items", "length", "piece", "score", "target", "label", "window", "_place", "_text"]


@pytest.fixture(scope="session")
def odd(spark):
    """``ODD_ROWS`` with more columns under names that the operators use themselves."""
    rows = [(*row, *[i] * len(CLASHES)) for i, row in enumerate(ODD_ROWS)]
    names = ", ".join(f"`{c}` long" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
