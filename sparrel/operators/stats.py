"""Column statistics, each a distributed aggregate.

Range (numeric columns), cardinality (exact up to a limit, HyperLogLog++ beyond it), density,
physical order along an ingest sequence, equi-depth histogram, and a uniform sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.functions.types import NUMERIC, tag_of


def column_statistics(df: DataFrame, exact_limit: int = 10_000, rsd: float = 0.01625) -> dict[str, dict]:
    """Statistics per column of the data model; an empty table has none.

    One pass estimates every cardinality. A second counts exactly the columns whose estimate lies
    near or under ``exact_limit``, so an exact set never grows past a bounded size.
    """
    tags = {f.name: tag for f in df.schema if (tag := tag_of(f.dataType))}
    ids = {name: f"c{n}" for n, name in enumerate(tags)}
    flat = df.select(*[F.col(f"`{name}`").alias(i) for name, i in ids.items()])
    aggregates = [F.count(F.lit(1)).alias("n")]
    for name, i in ids.items():
        aggregates.append(F.approx_count_distinct(i, rsd).alias(f"{i}_d"))
        if tags[name] in NUMERIC:
            aggregates += [F.min(i).alias(f"{i}_lo"), F.max(i).alias(f"{i}_hi")]
    row = flat.agg(*aggregates).first()
    if not row["n"]:
        return {}
    small = [i for i in ids.values() if row[f"{i}_d"] <= exact_limit * 1.1]
    exact = flat.agg(*[F.count_distinct(i).alias(i) for i in small]).first() if small else {}
    result = {}
    for name, i in ids.items():
        distinct = exact[i] if i in small else row[f"{i}_d"]
        entry = {"cardinality": distinct, "density": min(1.0, distinct / row["n"])}
        if tags[name] in NUMERIC:
            entry |= {"lower_bound": row[f"{i}_lo"], "upper_bound": row[f"{i}_hi"]}
        result[name] = entry
    return result


def range_and_density(df: DataFrame, column: str) -> DataFrame:
    """One row: lower_bound, upper_bound, cardinality (exact), density."""
    c = F.col(column)
    return df.agg(
        F.min(c).alias("lower_bound"),
        F.max(c).alias("upper_bound"),
        F.count_distinct(c).alias("cardinality"),
        (F.count_distinct(c).cast("double") / F.count(F.lit(1))).alias("density"),
    )


def value_ranks(df: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """(value, n, rank): each distinct value, how often it occurs, and the zero-based position of its first occurrence in sorted order.

    Equal values fold before the shuffle. Numeric values are cut into ``parts`` ranges at approximate quantiles that
    are part of the query, so a value's range never depends on how a plan is run; ranges are ranked side by side.
    """
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull())
    folded = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if tag_of(values.schema["value"].dataType) in NUMERIC:
        cuts = values.agg(F.percentile_approx("value", [k / parts for k in range(1, parts)], 1000).alias("cuts"))
        placed = folded.join(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    else:
        placed = folded.withColumn("part", F.lit(0))
    sizes = placed.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(offsets), "part").select("value", "n", (F.col("before") + F.col("inside")).alias("rank"))


def equi_depth_histogram(df: DataFrame, column: str, buckets: int = 10, most_strings: int = 50) -> DataFrame:
    """Rows (bucket, lower_bound, upper_bound, frequency); each bucket holds ceil(n/buckets) rows, the last one the rest.

    Strings have a histogram only if there are at most ``most_strings`` different ones; else the result is empty.
    """
    if tag_of(df.schema[column].dataType) not in NUMERIC:
        few = df.agg((F.approx_count_distinct(column, 0.01) <= most_strings).alias("few"))
        df = df.select(column).join(F.broadcast(few)).filter("few").drop("few")
    total = df.agg(F.ceil(F.count(column) / F.lit(float(buckets))).alias("depth"))
    ranked = value_ranks(df, column).join(F.broadcast(total))
    low, high = F.floor(F.col("rank") / F.col("depth")), F.floor((F.col("rank") + F.col("n") - 1) / F.col("depth"))
    spread = ranked.withColumn("bucket", F.explode(F.sequence(low, high)))
    inside = F.least(F.col("rank") + F.col("n"), (F.col("bucket") + 1) * F.col("depth")) - F.greatest(F.col("rank"), F.col("bucket") * F.col("depth"))
    return spread.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.min("value").alias("lower_bound"), F.max("value").alias("upper_bound"), F.sum(inside).alias("frequency"))


def is_ordered(df: DataFrame, column: str, sequence: str, stretch: int = 1_000_000) -> DataFrame:
    """One row (``is_ordered``): no value is below its predecessor along ``sequence``.

    The sequence is cut into stretches that are checked side by side; only their first and last
    values meet in one place.
    """
    rows = df.select(F.col(sequence).alias("s"), F.col(column).alias("v")).withColumn("part", F.floor(F.col("s") / stretch))
    inside = Window.partitionBy("part").orderBy("s")
    checked = rows.withColumn("down", F.coalesce(F.col("v") < F.lag("v").over(inside), F.lit(False)))
    parts = checked.groupBy("part").agg(F.bool_or("down").alias("down"), F.min_by("v", "s").alias("first"), F.max_by("v", "s").alias("last"))
    across = F.coalesce(F.col("first") < F.lag("last").over(Window.orderBy("part")), F.lit(False))
    return parts.select((F.col("down") | across).alias("down")).agg((~F.coalesce(F.bool_or("down"), F.lit(False))).alias("is_ordered"))


def physically_ordered(table: DataFrame, stretch: int = 1_000_000) -> list[str]:
    """The columns of a Parquet table in which no value is below the one stored before it, by file name and row.

    Stretches of each file are checked side by side, all columns in one pass; only their edges meet. Nulls are passed over.
    """
    names = [f.name for f in table.schema if tag_of(f.dataType)]
    if not names:
        return []
    columns = range(len(names))
    row = F.col("_metadata.row_index")
    rows = table.select(F.col("_metadata.file_path").alias("f"), F.floor(row / stretch).alias("part"), row.alias("s"), *[F.col(f"`{c}`").alias(f"v{n}") for n, c in enumerate(names)])
    before = Window.partitionBy("f", "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    checked = rows.select("f", "part", "s", *[f"v{n}" for n in columns], *[(F.col(f"v{n}") < F.last(f"v{n}", True).over(before)).alias(f"d{n}") for n in columns])
    edges = [x for n in columns for x in (F.bool_or(f"d{n}").alias(f"d{n}"), F.min_by(f"v{n}", F.when(F.col(f"v{n}").isNotNull(), F.col("s"))).alias(f"a{n}"), F.max_by(f"v{n}", F.when(F.col(f"v{n}").isNotNull(), F.col("s"))).alias(f"z{n}"))]
    parts = checked.groupBy("f", "part").agg(*edges)
    earlier = Window.orderBy("f", "part").rowsBetween(Window.unboundedPreceding, -1)
    across = [F.coalesce(F.col(f"d{n}") | (F.col(f"a{n}") < F.last(f"z{n}", True).over(earlier)), F.col(f"d{n}"), F.col(f"a{n}") < F.last(f"z{n}", True).over(earlier)).alias(f"d{n}") for n in columns]
    found = parts.select(*across).agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(f"d{n}").alias(f"d{n}") for n in columns]).first()
    return [c for n, c in enumerate(names) if found["n"] and not found[f"d{n}"]]


def uniform_sample(df: DataFrame, rows: int = 10_000, seed: int = 0) -> DataFrame:
    """A uniform sample of at most ``rows`` rows: the operator's feature, fixed by its seed."""
    return df.orderBy(F.rand(seed)).limit(rows)


def is_numeric(kind: T.DataType) -> bool:
    return tag_of(kind) in NUMERIC
