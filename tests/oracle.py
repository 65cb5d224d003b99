"""Spark results held against DuckDB on the same tables: columns by name, rows as a multiset."""

import datetime
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def database(d):
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def same(df, con, sql):
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    other = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert len(rows) == len(other)
    assert sorted(map(repr, rows)) == sorted(map(repr, other))
