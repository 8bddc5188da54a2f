"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def rows(table):
    columns = [table.column(c).to_pylist() for c in sorted(table.column_names)]
    return sorted(tuple(map(repr, row)) for row in zip(*columns))


def test_sql_is_given_for_registered_queries_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    expected = con.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(expected.column_names)
    assert rows(got) == rows(expected)
