"""Every registered query against its SQL; queries without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, duck):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        assert compare(df, duck, entry.oracle_sql()[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
