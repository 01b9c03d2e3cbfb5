"""Ingest a folder of delimited tables: Parquet for queries, a catalog with statistics, block files and a SQLite copy on request.

``python -m sparrel.ingest SOURCE TARGET [TABLE...] [--sqlite] [--blocks]``; without tables, all that are found.
"""

from __future__ import annotations

import sys

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from sparrel.catalog import Catalog
from sparrel.functions.types import tag_of
from sparrel.operators.stats import physically_ordered
from sparrel.sources.blocks import encode_blocks
from sparrel.sources.delimited import catalog_of_folder, discover
from sparrel.sources.metadata import dump_catalog, table_entry
from sparrel.sources.sqlite_export import export_table


def open_output(path: str):
    """A binary file to write, local or in a store that a URI names."""
    store, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return store.open_output_stream(place)


def write_block_file(df, path: str, block_size: int = 4096) -> None:
    """One slotted block file; rows reach the driver a partition at a time."""
    tags = [tag_of(f.dataType) for f in df.schema]
    with open_output(path) as f:
        for block in encode_blocks(df.toLocalIterator(), tags, block_size):
            f.write(block)


def ingest(spark: SparkSession, source: str, target: str, tables: list[str] | None = None, sqlite: bool = False, blocks: bool = False) -> Catalog:
    """Write ``<table>.parquet`` for each table and ``catalog.json``; returns a catalog of the Parquet tables. Without ``tables``, all that are found."""
    tables = discover(spark, source) if tables is None else tables
    raw = catalog_of_folder(spark, source, tables)
    catalog, entries = Catalog.parquet(spark, target), []
    for name in tables:
        raw.table(name).write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        stored = catalog.table(name)
        entries.append(table_entry(name, stored, ordered=physically_ordered(stored)))
        if sqlite:
            export_table(stored, name, f"{target}/tables.db")
        if blocks:
            write_block_file(stored, f"{target}/{name}.bin")
    with open_output(f"{target}/catalog.json") as f:
        f.write(dump_catalog(entries).encode())
    return catalog


def main(argv: list[str]) -> int:
    flags, words = {a for a in argv if a.startswith("--")}, [a for a in argv if not a.startswith("--")]
    if len(words) < 2 or flags - {"--sqlite", "--blocks"}:
        sys.exit(__doc__)
    spark = SparkSession.builder.appName("sparrel-ingest").getOrCreate()
    ingest(spark, words[0], words[1], words[2:] or None, "--sqlite" in flags, "--blocks" in flags)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
