"""Every query against its SQL in DuckDB, on the tables of one scale factor."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
RUNS, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = Path(SF_DIR) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, float) and value == 0:
        return "0.0"
    return repr(value)


def kind(value):
    return "number" if type(value).__name__ in ("int", "float") else type(value).__name__


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, duck, name):
    got = RUNS[name](spark, SF_DIR)
    rows = [tuple(r) for r in got.collect()]
    if name not in SQL:
        assert got.columns and rows
        return
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    expected = found.fetchall()
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in got.columns]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in expected)
    rows = sorted(tuple(map(plain, r)) for r in rows)
    if rows != expected:
        only_got = sorted(set(rows) - set(expected))[:5]
        only_want = sorted(set(expected) - set(rows))[:5]
        pytest.fail(f"{len(rows)} rows, want {len(expected)}\ncolumns {got.columns}\n got {only_got}\nwant {only_want}")


def test_entry(spark):
    assert entry(spark).count() > 0
