"""Delimited text with a two-line schema file: names, then type words, both ``|``-separated.

Rows may end in one extra ``|``. Quoting does not exist. A row with too few or too many fields,
or a field that is not of its type, fails the read instead of shortening the table.
"""

from __future__ import annotations

import warnings
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.catalog import Catalog
from sparrel.functions.types import SPARK_TYPES, STRING, parse_schema_word


def parse_schema(text: str) -> T.StructType:
    lines = text.splitlines()
    if len(lines) < 2:
        raise ValueError("a schema file has a line of names and a line of types")
    names, words = (line.strip().removesuffix("|").split("|") for line in lines[:2])
    if len(names) != len(words):
        raise ValueError(f"{len(names)} names but {len(words)} types")
    return T.StructType([T.StructField(n, SPARK_TYPES[parse_schema_word(w)], False) for n, w in zip(names, words, strict=True)])


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    return parse_schema("\n".join(r.value for r in spark.read.text(path).head(2)))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lazily read a file or folder; every check is part of the row expression."""
    return parse_rows(spark.read.text(path), schema)


def parse_rows(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows of lines in a column ``value``."""
    parts = F.split("value", r"\|", -1)
    width = len(schema)
    trailing = (F.size("parts") == width + 1) & (F.element_at("parts", -1) == "")
    rows = lines.select("value", parts.alias("parts"))
    wrong = F.raise_error(F.concat(F.lit(f"expected {width} fields: "), F.col("value")))
    fields = F.when(trailing | (F.size("parts") == width), F.col("parts")).otherwise(wrong)
    checked = rows.select(fields.alias("parts"))
    columns = []
    for n, f in enumerate(schema):
        raw = F.col("parts")[n]
        if f.dataType == SPARK_TYPES[STRING]:
            typed = raw
        else:
            bad = F.raise_error(F.concat(F.lit(f"bad value in {f.name}: "), raw)).cast(f.dataType)
            typed = F.coalesce(F.expr(f"try_cast(parts[{n}] AS {f.dataType.simpleString()})"), bad)
        columns.append(typed.alias(f.name))
    return checked.select(*columns)


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder, wherever Spark reads: files ``<table>.csv`` that have a ``<table>.schema``. Others get a warning."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,schema}").load(folder).select("path").collect()
    files = {unquote(r.path.rsplit("/", 1)[1]) for r in listed}
    tables = sorted(f.removesuffix(".csv") for f in files if f.endswith(".csv"))
    for name in tables:
        if f"{name}.schema" not in files:
            warnings.warn(f"{name}.csv has no schema file and is passed over", stacklevel=2)
    return [name for name in tables if f"{name}.schema" in files]


def catalog_of_folder(spark: SparkSession, folder: str, tables: list[str] | None = None) -> Catalog:
    """A catalog of ``<table>.csv`` files, each beside its ``<table>.schema``; without ``tables``, of all that are found."""
    catalog = Catalog()
    for name in discover(spark, folder) if tables is None else tables:
        base = f"{folder.rstrip('/')}/{name}"
        catalog.register(name, read_delimited(spark, f"{base}.csv", read_schema(spark, f"{base}.schema")))
    return catalog
