"""Every registered query gives on the smallest tables what its SQL gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

Q, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("set TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if v is not None and not isinstance(v, (int, str)) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", [n for n in Q if n in SQL])
def test_query_matches_sql(spark, data, con, name):
    got = Q[name](spark, data)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in Q if n not in SQL])
def test_query_runs(spark, data, name):
    Q[name](spark, data).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
