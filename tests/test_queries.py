"""Registered queries of the reference's operators against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)  # integers and times to the last digit


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in frame.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    at = {c: i for i, c in enumerate(found.columns)}
    assert sorted(at) == columns
    assert rows == sorted(tuple(cell(r[at[c]]) for c in columns) for r in found.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
