"""Table registry: names to lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


_schemas: WeakKeyDictionary = WeakKeyDictionary()


def _open(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. Its schema is read once per session; its files are listed anew."""
    known = _schemas.setdefault(spark, {})
    if path not in known:
        known[path] = spark.read.parquet(path).schema
    return spark.read.schema(known[path]).parquet(path)


class Catalog:
    """Named tables. A resolver makes frames for names that nobody registered, once each."""

    def __init__(self, resolver: Callable[[str], DataFrame] | None = None) -> None:
        self._resolver = resolver
        self._tables: dict[str, DataFrame] = {}

    @staticmethod
    def cached(spark: SparkSession, folder: str) -> Catalog:
        """Like ``parquet``, for tables whose schemas stay: a plan over many tables starts without a job for each."""
        return Catalog(lambda name: _open(spark, f"{folder.rstrip('/')}/{name}.parquet"))

    @staticmethod
    def parquet(spark: SparkSession, folder: str) -> Catalog:
        """Tables ``<folder>/<name>.parquet``; files are opened when a plan scans them."""
        return Catalog(lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))

    def register(self, name: str, frame: DataFrame) -> Catalog:
        self._tables[name] = frame
        return self

    def names(self) -> list[str]:
        return sorted(self._tables)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            if self._resolver is None:
                raise ValueError(f"unknown table {name!r}")
            try:
                self._tables[name] = self._resolver(name)
            except Exception as error:
                raise ValueError(f"unknown table {name!r}: {error}") from error
        return self._tables[name]
