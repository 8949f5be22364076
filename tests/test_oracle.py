"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_file
from dockside.plans.catalog import QUERIES
from dockside.plans.oracle import ORACLE_SQL as SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(
    not pathlib.Path(FOLDER).exists(), reason="the test tables are not here"
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_file.queries())
    assert set(SQL) <= set(entry_file.oracle_sql()) <= set(entry_file.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    columns = [field[0] for field in result.description]
    assert sorted(df.columns) == sorted(columns)
    mine = comparable(df.columns, [tuple(row) for row in df.collect()])
    assert mine == comparable(columns, result.fetchall())
    assert mine


def test_entry(spark):
    assert entry_file.entry(spark).count() == 5
