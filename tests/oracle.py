"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import os

import duckdb

from tests.conftest import SMALL


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def both(spark, query, sql, folder=SMALL):
    """(sorted rows of the query, sorted rows of the SQL), columns by name."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    df = query(spark, folder)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert names == sorted(columns)
    at = [columns.index(c) for c in names]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    return sorted(got, key=repr), sorted(want, key=repr)
