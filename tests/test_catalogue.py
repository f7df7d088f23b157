"""Queries against their SQL on DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from adlens.catalogue import load

D = "/root/testdata/sf0.001"
SQL = sorted(name for name, (_, sql) in load().items() if sql)


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, datetime.datetime):
        return str(x)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", SQL)
def test_query(spark, con, name):
    run, sql = load()[name]
    df = run(spark, D)
    rel = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall()), key=str)
    assert got == want
