"""Every core query against its DuckDB statement."""

import pytest
from compare import assert_same, connect, rows_of

from rxweave.queries import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, data, name):
    assert_same(spark, con, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_the_same_rows_twice(spark, data, name):
    df = QUERIES[name](spark, data)
    first = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert first and df.columns and len(set(df.columns)) == len(df.columns)
    again = QUERIES[name](spark, data)
    assert first == rows_of(again.columns, [tuple(r) for r in again.collect()])
