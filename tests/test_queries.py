"""Every registered query against its SQL counterpart, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    listed = ", ".join(f'"{c}"' for c in columns)
    result = db.execute(f"SELECT * FROM ({sql})")
    assert sorted(c[0] for c in result.description) == columns
    assert rows == sorted(map(repr, db.execute(f"SELECT {listed} FROM ({sql})").fetchall()))


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "title", "updated"]
