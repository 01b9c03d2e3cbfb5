"""Copy of tables in a SQLite file, for checking results with another engine.

The sink is one local file by nature: rows reach the driver a partition at a time and go in by
bound batches.
"""

from __future__ import annotations

import sqlite3
from itertools import islice

from pyspark.sql import DataFrame

from sparrel.functions.types import F32, F64, I32, I64, STRING, tag_of

# Storage classes of the scalar kinds.
_STORAGE = {I32: "INTEGER", I64: "INTEGER", F32: "REAL", F64: "REAL", STRING: "TEXT"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def export_table(df: DataFrame, name: str, path: str, batch: int = 1024) -> int:
    """Create a table and fill it; returns the number of rows. Other types than the five kinds travel as text."""
    tags = [tag_of(f.dataType) for f in df.schema]
    columns = [f"{_quoted(f.name)} {_STORAGE.get(t, 'TEXT')}" for f, t in zip(df.schema, tags, strict=True)]
    ids = df.toDF(*[f"c{n}" for n in range(len(tags))])
    rows = iter(ids.select(*[ids[f"c{n}"] if t in _STORAGE else ids[f"c{n}"].cast("string") for n, t in enumerate(tags)]).toLocalIterator())
    insert = f"INSERT INTO {_quoted(name)} VALUES ({', '.join('?' * len(tags))})"
    total = 0
    with sqlite3.connect(path) as con:
        con.execute(f"CREATE TABLE {_quoted(name)} ({', '.join(columns)})")
        while part := [tuple(r) for r in islice(rows, batch)]:
            con.executemany(insert, part)
            total += len(part)
    con.close()
    return total
