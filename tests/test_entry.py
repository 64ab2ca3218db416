"""The registered queries against their SQL, on the smallest of the given tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from registry.oracle import ORACLE
from registry.queries import QUERIES
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_of_the_engine_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    frame = entry.queries()[name](spark, FOLDER)
    result = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert compare(frame.columns, map(tuple, frame.collect()), columns, result.fetchall()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).columns == ["type", "n_rows"]
