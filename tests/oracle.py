"""Spark rows against DuckDB's."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql, sf_dir):
    con = duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
    return len(got)
