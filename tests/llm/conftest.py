from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A small documents table with columns no operator asked for, and names the operators use inside."""

    def make(rows, schema="doc_id long, text string, source string"):
        df = spark.createDataFrame(rows, schema).repartition(3)
        for extra in ("id", "class", "label", "key", "bucket", "kept", "score", "h", "ck", "c0", "_id", "size", "position"):
            if extra not in df.columns:
                df = df.selectExpr("*", f"'x' AS `{extra}`")
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """NULL, empty, blank, short and long texts, ties and repeats, control characters."""
    long = " ".join(f"word{i * 7919 % 9973}" for i in range(30_000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (6, "a b c d", ""),
        (7, long, "a"), (8, long, "a"), (9, long + " end", "b"), (None, "no id at all here", "a"), (None, None, None),
        (10, "ÉCOLE Été 日本語 ß\x00\x1c <|endoftext|> x", "b"), (11, "The The The The The The The", "a"), (12, "a" * 5000, "a"), (13, "ab" * 3000, "a"),
    ]
