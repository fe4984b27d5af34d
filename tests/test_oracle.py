"""Every query that has SQL gives the same rows as DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
CORE = [n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit())]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "quantize"):
        return round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert sum(got.values()) > 0
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
