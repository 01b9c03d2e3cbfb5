"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import bytes_of, materialize


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Edges within so many bytes of files are joined by broadcast, without files of their own for each step.
_FEW = 4 << 20


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Connect each node's larger (or, small star, no larger) neighbours to the smallest node around it."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(flipped) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # Written first if it is large, so the join below reads two tables: a hub's rows can be split among tasks.
    least = F.broadcast(least) if few else materialize(least, "least")
    joined = around.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; the component is its smallest node.

    Degrees are folded before every shuffle and no node's neighbours meet in one place. Each step
    is written to the shared folder; the rounds grow with the logarithm of the number of nodes.
    """
    now = materialize(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b").distinct(), "edges")
    seen = _sum(now)
    while seen[0]:
        few = bytes_of(now) <= _FEW
        wide = _star(now, True, few)
        now = materialize(_star(wide if few else materialize(wide, "edges"), False, few), "edges")
        if (found := _sum(now)) == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
