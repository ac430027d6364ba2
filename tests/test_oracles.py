"""Each query that has SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import os

import duckdb
import pytest

from ledgerloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal, int)):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.date().isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


def same(frame, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
