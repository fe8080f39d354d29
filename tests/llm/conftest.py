from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _row bigint"


@pytest.fixture
def docs(spark):
    """A table of documents with two more columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "mine", 7) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, and repeated rows."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "One two, three."), (3, "One two, three."), (None, "no id here at all"), (4, long), (5, " \n\n "), (6, "x")]
    return docs(rows)


@pytest.fixture
def nothing(docs):
    return docs([])
