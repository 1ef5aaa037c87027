"""Every registered query runs and matches its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, views

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_sql_names_are_registered():
    assert set(SQL) <= set(entry.queries())


# The queries over documents have tests of their own.
@pytest.mark.parametrize("name", list(entry.retail_queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.columns and df.collect() is not None
