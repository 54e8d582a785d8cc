"""Rows of a query and of its SQL, made comparable."""

import datetime
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def check(con, df, sql):
    want = con.sql(sql)
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    at = [want.columns.index(c) for c in cols]
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == rows
