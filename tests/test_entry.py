"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry
from passagelake.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["q_id", "rank", "chunk_pos"] and out.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = QUERIES[name](spark, DATA)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    assert mine == sorted(tuple(map(plain, r)) for r in want.fetchall())
