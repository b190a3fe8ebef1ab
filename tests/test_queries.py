"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as contract
from citewerk.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings events labels pages conversations benchmark".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6))
    return value if value is None or isinstance(value, (bool, int)) else str(value)


def rows(columns, raw):
    return sorted((tuple(normal(r[c]) for c in columns) for r in raw), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = contract.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = rows(columns, [dict(zip(names, r)) for r in result.fetchall()])
    assert rows(columns, [r.asDict() for r in found.collect()]) == expected
    assert expected, "a query that finds nothing checks nothing"


def test_entry(spark):
    assert contract.entry(spark).count() == 10
