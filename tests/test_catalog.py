"""Each query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lorekeep.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, data):
    return sorted(tuple(plain(r[c]) for c in columns) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    want = con.execute(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    assert rows(columns, got) == rows(columns, want.to_pylist())
