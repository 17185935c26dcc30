"""Compares a query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import os


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 8)
    return tuple(map(_norm, v)) if isinstance(v, list | tuple) else v


def same(spark, con, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want
