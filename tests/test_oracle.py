"""Every query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from corpusloom.plans.catalogue import QUERIES, SQL

D = "/root/testdata/sf0.001"


def plain(v):
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return v
    return None if v != v else round(float(v), 5) + 0.0


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, D)
    got = db.execute(SQL[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    rows = got.fetchall()
    order = sorted(cols)
    a = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    b = sorted(repr(tuple(plain(r[cols.index(c)]) for c in order)) for r in rows)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, D)
    assert df is None or df.count() >= 0
