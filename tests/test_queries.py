"""Registered queries against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# Long runs; tools/check.py covers them.
SLOW = {"R7_smote_tomek", "R9_change_report", "R4_smote_multiclass", "T2_port_scan_stream", "T9_detector_stream"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10
    assert rows == sorted(rows, key=lambda r: r["timestamp"], reverse=True)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())
