"""Every registered query that has an SQL counterpart gives the same rows and types in DuckDB."""

import pytest
from compare import differences, duck

import __spark_entry__ as registered

FOLDER = "/root/testdata/sf0.001"
SQL = registered.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, connection, name):
    assert differences(registered.queries()[name](spark, FOLDER), connection, SQL[name]) == []


def test_every_counterpart_belongs_to_a_query():
    assert set(SQL) <= set(registered.queries())


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert sorted(r.stage for r in rows) == ["private", "public"]
    assert all(0 < r.score < 1 for r in rows)
