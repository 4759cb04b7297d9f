"""Every registered query that SQL can express gives the same rows in DuckDB."""

import pytest

import oracle
from riskspark.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf, name):
    ok, message = oracle.compare(spark, con, sf, QUERIES[name], SQL[name])
    assert ok or message == "no rows", message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 3 and "auroc" in df.columns
