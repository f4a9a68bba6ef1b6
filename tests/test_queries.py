"""Every query with SQL is held against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from millrace import queries

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("MILLRACE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(round(float(value), 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted([plain(v) for v in r] for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    sql = duck.sql(queries.ORACLE[name])
    assert sorted(sql.columns) == columns
    at = [list(sql.columns).index(c) for c in columns]
    want = sorted([plain(r[i]) for i in at] for r in sql.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 11
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
