"""Every query against its DuckDB counterpart on the same tables, whatever the order of rows."""

import duckdb
import pytest

import __spark_entry__ as contract
from workload.spark_queries import QUERIES

TABLES = "region nation customer supplier part orders documents".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_duckdb(spark, sf, duck, name):
    df = contract.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = [tuple(row[c] for c in columns) for row in df.collect()]
    result = duck.execute(contract.oracle_sql()[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    expected = [tuple(row[theirs.index(c)] for c in columns) for row in result.fetchall()]
    assert ours
    assert _sorted(ours) == _sorted(expected)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
