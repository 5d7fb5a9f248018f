from __future__ import annotations

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text[, lang, source]) as a documents table."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def odd_documents(documents):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and a column with a clashing name."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (None, "some text here", "en", "a"), (None, None, None, None),
        (3, long, "en", "a"), (3, long, "en", "a"), (4, "one", "en", None), (5, "one", "de", "b"), (6, "\n\n", None, "b"),
        (7, "12 34 !!", "en", "b"), (8, "  \t ", None, "c"), (9, "ünïcode — 漢字 🙂 İ", "de", "c"),
    ]
    df = documents(rows)
    return df.selectExpr("*", "'x' AS score", "0 AS rank", "'y' AS key", "'z' AS size")
