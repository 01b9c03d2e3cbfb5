"""Catalog files: table names, column types and statistics as JSON."""

from __future__ import annotations

import json
from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparrel.functions.types import CATALOG_NAMES, NUMERIC, SPARK_TYPES, catalog_name, tag_of
from sparrel.operators.stats import column_statistics, equi_depth_histogram


def _span(kind: str, low, high) -> dict:
    return {"lower_bound": {kind: low}, "upper_bound": {kind: high}}


def table_entry(name: str, df: DataFrame, file_id: str | None = None, ordered: Collection[str] = ()) -> dict:
    """A catalog entry with statistics of every column of the data model; ``ordered`` names those that are stored in ascending order."""
    stats = column_statistics(df)
    columns = []
    for f in df.schema:
        if (tag := tag_of(f.dataType)) is None or tag not in CATALOG_NAMES.values():
            raise ValueError(f"column {f.name!r} has no catalog type")
        kind, entries = catalog_name(tag), []
        if s := stats.get(f.name):
            if f.name in ordered:
                entries.append("IsPhysicallyOrdered")
            if tag in NUMERIC:
                entries.append({"RangeStat": _span(kind, s["lower_bound"], s["upper_bound"])})
            entries += [{"CardinalityStat": s["cardinality"]}, {"DensityStat": s["density"]}]
            # At most as many rows as buckets.
            points = equi_depth_histogram(df, f.name).orderBy("bucket").collect()
            if points:
                entries.append({"HistogramStat": {"frequency_points": [[_span(kind, p.lower_bound, p.upper_bound), p.frequency] for p in points]}})
        columns.append({"column_name": f.name, "data_type": kind, "stats": entries})
    return {"name": name, "file_id": file_id or name, "column_specs": columns}


def dump_catalog(entries: list[dict]) -> str:
    return json.dumps({"table_specs": entries}, indent=1)


def load_schemas(text: str) -> dict[str, T.StructType]:
    """Spark schemas by table name."""
    found = {}
    for table in json.loads(text)["table_specs"]:
        fields = [T.StructField(c["column_name"], SPARK_TYPES[CATALOG_NAMES[c["data_type"]]], False) for c in table["column_specs"]]
        found[table["name"]] = T.StructType(fields)
    return found
