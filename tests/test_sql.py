"""Every query that has SQL gives the rows DuckDB gives."""

import pytest

import __spark_entry__ as entry
from termloom.plans import oracle, queries
from tests.compare import database, differences, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"
# The library's own queries; those of optional modules have tests of their own.
SQL, QUERIES = oracle.SQL, queries.QUERIES


@pytest.fixture(scope="module")
def duck():
    return database(SF_DIR)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    left = spark_rows(QUERIES[name](spark, SF_DIR))
    assert left[1], "a query without rows checks nothing"
    assert differences(left, sql_rows(duck, SQL[name])) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"silhouette_sweep"}))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["doc_id", "rank", "term", "tfidf"]
    assert result.count() > 0
