"""Compares a query with its SQL on the same tables, rows in any order."""

import math
import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return db


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def same(db, df, sql):
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in found.fetchall())
    assert ours == theirs
