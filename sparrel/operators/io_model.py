"""Mechanical disk cost model over an I/O trace, as a projection over windows of bounded stretches.

A trace row is (seq, kind, start_block, num_blocks). Costs follow the head's last cylinder and
block, which are those of the previous non-empty request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Geometry:
    # Defaults of the simulated disk.
    block_size: int = 4096
    rpm: int = 7200
    blocks_per_track: int = 1024
    heads: int = 4
    cylinders: int = 500_000
    track_to_track_ms: float = 0.8
    full_stroke_ms: float = 18.0
    mb_per_second: float = 150.0

    def __post_init__(self) -> None:
        if min(self.block_size, self.rpm, self.blocks_per_track, self.heads, self.cylinders) <= 0 or self.mb_per_second <= 0:
            raise ValueError("disk geometry must be positive")


def _last_end(trace: DataFrame, per_device: str | None, stretch: int) -> DataFrame:
    """The non-empty requests with ``last_end``, the last block of the request before.

    The sequence is cut into stretches that are windowed side by side; only their last requests meet
    in one place.
    """
    device = F.col(per_device) if per_device else F.lit(0)
    end = F.col("start_block") + F.col("num_blocks") - 1
    busy = trace.filter("num_blocks > 0").withColumns({"_device": device, "_part": F.floor(F.col("seq") / stretch), "_end": end})
    inside = Window.partitionBy("_device", "_part").orderBy("seq")
    ends = busy.groupBy("_device", "_part").agg(F.max_by("_end", "seq").alias("_final"))
    carried = ends.select(F.col("_device").alias("_d"), F.col("_part").alias("_p"), F.lag("_final").over(Window.partitionBy("_device").orderBy("_part")).alias("_carried"))
    same = F.col("_device").eqNullSafe(F.col("_d")) & F.col("_part").eqNullSafe(F.col("_p"))
    joined = busy.withColumn("_before", F.lag("_end").over(inside)).join(carried, same)
    return joined.withColumn("last_end", F.coalesce("_before", "_carried", F.lit(0))).drop("_device", "_part", "_end", "_d", "_p", "_carried", "_before")


def request_costs(trace: DataFrame, disk: Geometry = Geometry(), per_device: str | None = None, stretch: int = 1_000_000) -> DataFrame:
    """The non-empty requests of a trace with seek_ms, rotation_ms, transfer_ms and cylinders.

    A device's requests follow one head; ``per_device`` names the column that tells devices apart.
    """
    per_cylinder = disk.blocks_per_track * disk.heads
    end = F.col("start_block") + F.col("num_blocks") - 1
    busy = _last_end(trace, per_device, stretch)
    first, final, before = (F.floor(x / per_cylinder) for x in (F.col("start_block"), end, F.col("last_end")))
    far = F.abs(first - before)
    reach = disk.track_to_track_ms + (disk.full_stroke_ms - disk.track_to_track_ms) * F.sqrt(F.least(F.lit(1.0), far / disk.cylinders))
    seek = F.when(far == 0, 0.0).when(far == 1, disk.track_to_track_ms).otherwise(reach) + (final - first) * disk.track_to_track_ms
    rotation = F.when(F.col("start_block") == F.col("last_end") + 1, 0.0).otherwise(0.5 * 60000 / disk.rpm)
    transfer = F.col("num_blocks") * disk.block_size / 1e6 / disk.mb_per_second * 1000
    return busy.select(
        "*",
        F.round(seek, 6).alias("seek_ms"),
        F.round(rotation, 6).alias("rotation_ms"),
        F.round(transfer, 6).alias("transfer_ms"),
        (far + final - first).alias("cylinders"),
    )


def io_report(trace: DataFrame, disk: Geometry = Geometry(), per_device: str | None = None) -> DataFrame:
    """One row of totals: reads, writes, blocks, cylinders, and microseconds by kind."""
    counts = trace.agg(
        F.count_if(F.col("kind") == "get").alias("reads"),
        F.count_if(F.col("kind") == "put").alias("writes"),
        F.coalesce(F.sum("num_blocks"), F.lit(0)).alias("blocks"),
    )
    micro = {k: F.coalesce(F.sum(f"{k}_ms"), F.lit(0.0)) * 1000 for k in ("seek", "rotation", "transfer")}
    totals = request_costs(trace, disk, per_device).agg(
        F.coalesce(F.sum("cylinders"), F.lit(0)).alias("cylinders"),
        *[v.alias(f"{k}_us") for k, v in micro.items()],
        sum(micro.values(), F.lit(0.0)).alias("total_us"),
    )
    return counts.join(F.broadcast(totals))


def nonsequential_requests(trace: DataFrame) -> DataFrame:
    """One row ``nonseq``: requests that do not start right after the previous one ended."""
    costs = request_costs(trace)
    return costs.agg(F.coalesce(F.sum((F.col("rotation_ms") > 0).cast("long")), F.lit(0)).alias("nonseq"))
