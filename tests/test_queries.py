import pytest

import __spark_entry__ as entry
from graphloom import queries as core


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_agrees_with_sql(spark, sf, same, name):
    same(core.QUERIES[name](spark, sf), core.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "pos"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
