"""Compare a query with its SQL run by DuckDB over the same tables."""

import datetime as dt
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def check(df, sql, sf):
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    with connect(sf) as c:
        assert sorted(c.sql(sql).columns) == names
        want = sorted((tuple(map(plain, r)) for r in c.sql(f"select {', '.join(f'"{n}"' for n in names)} from ({sql})").fetchall()), key=repr)
    assert got == want
