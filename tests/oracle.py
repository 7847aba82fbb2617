"""Compares a query with its DuckDB SQL over the same tables."""

import math
import os
from decimal import Decimal

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in os.listdir(folder):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, Decimal):
        return round(float(v), 4)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def assert_same(df, connection, sql):
    names = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[k]) for k in names)) for r in df.collect())
    r = connection.execute(sql)
    theirs = [x[0] for x in r.description]
    assert sorted(theirs) == names
    at = [theirs.index(k) for k in names]
    assert ours == sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
