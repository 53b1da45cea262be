"""Comparison of a query with its oracle in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def compare(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    mine = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr)
    theirs = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert list(map(repr, mine)) == list(map(repr, theirs))
