"""Every registered query against its SQL on DuckDB (or a row check where it has none)."""

import glob
import os

import duckdb
import pytest

from routelab.plans import catalog
from tools.check import norm

catalog.load()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = catalog.ORACLES.get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    pos = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[p]) for p in pos) for r in cur.fetchall())
