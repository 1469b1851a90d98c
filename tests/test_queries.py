"""Every registered query against its SQL counterpart."""

import pytest
from check import compare
from conftest import SF

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, name) is None


def test_every_query_has_sql():
    assert set(entry.SQL) == set(entry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["company", "count"] and df.count() == 5
