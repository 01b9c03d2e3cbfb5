"""Row comparison against DuckDB over the same Parquet files."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return f"{v:.12g}"
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


def same_rows(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [df.columns.index(n) for n in names]
    want = Counter(tuple(map(norm, r)) for r in found.fetchall())
    got = Counter(tuple(norm(r[i]) for i in order) for r in df.collect())
    assert got == want
