"""Registered queries against DuckDB on the smallest tables (a part by default, all with FLOWGLASS_ALL=1)."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.oracle_sql())
PICK = NAMES if os.environ.get("FLOWGLASS_ALL") else NAMES[::4]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", PICK)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["threat_class", "detector", "alerts", "sources"]
