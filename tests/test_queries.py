"""Every registered query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, database, name):
    found = canonical(QUERIES[name](spark, SF).toPandas())
    if name not in ORACLES:
        assert len(found)
        return
    expected = canonical(database.execute(ORACLES[name]).df())
    assert list(found.columns) == list(expected.columns)
    assert len(found) == len(expected)
    same = (found == expected) | (found.isna() & expected.isna())
    assert same.all().all(), found[~same.all(axis=1)].head()


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
