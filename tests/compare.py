"""Spark rows against DuckDB rows of the same tables."""

import os

import duckdb


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def duck(sql, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return names, r.fetchall()


def same(df, sql, folder):
    names, rows = duck(sql, folder)
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    a = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    at = [names.index(c) for c in cols]
    b = sorted((tuple(norm(r[i]) for i in at) for r in rows), key=str)
    assert a == b
