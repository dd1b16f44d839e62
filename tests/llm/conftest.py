import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers_llm import edited, prose  # noqa: E402


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use inside."""

    def make(rows):
        rows = [(i, t, s, 1, "x", True, 2, 3, "z", 5) for i, t, s in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, class string, kept boolean, h long, key int, label string, labelled long")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids and sources, repeats, ties, one very long text."""
    long = prose(1, 60_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "ONE", "b"), (6, "one two", "b"),
        (7, prose(2, 80), "b"), (7, prose(2, 80), "b"), (8, prose(2, 80), None), (9, prose(2, 80) + "\n", "c"), (9, prose(3, 40), "c"),
        (None, prose(3, 40), "c"), (None, None, "c"), (10, long, "a"), (11, edited(long, 5, 60), "a"), (12, "éß \U0001f600 x", "b"), (13, "x y z", ""),
    ]


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
