"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from furrow.plans import catalog, geometry, grid, hydrology, io, logistics, scalars, scenario

SF = "/root/testdata/sf0.001"
CASES = [(n, q, p.ORACLES[n]) for p in (scalars, hydrology, grid, geometry, logistics, scenario, catalog, io) for n, q in p.QUERIES.items() if n in p.ORACLES]


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    db.sql("set timezone='UTC'")
    for f in os.listdir(SF):
        db.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return db


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    return f"{v:.6g}" if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v).replace("+00:00", "")


@pytest.mark.parametrize(("name", "run", "sql"), CASES, ids=[c[0] for c in CASES])
def test_same_rows(spark, tables, name, run, sql):
    got = run(spark, SF)
    columns = sorted(got.columns)
    want = tables.sql(sql)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs
