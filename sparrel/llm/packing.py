"""Best-fit packing with certified bin counts.

Documents are tokenized once into pieces of at most ``capacity`` tokens. Pieces are dealt evenly to
tasks; each packs its own by best fit, longest first, and certifies the bin count with lower bounds
from dual-feasible functions. Where a bound is not met, the task's pieces, and the pieces of poorly
filled sequences elsewhere, are dealt anew and packed again, as long as a round saves sequences. The
bin counts and bounds are part of the result.

Defined cases: a null or empty text is its end id alone; repeated rows are packed as often as they
occur; null ids stay null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import materialize
from sparrel.llm.tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, row long, task int, bin int, offset long, fill int, bins int, bound int"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32)."""
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1)), strict=True):
                raw = ids.tobytes() + tail
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    A dual-feasible function never maps the items of one full bin above the capacity, so the mapped
    total over the capacity bounds the bins from below. The first family rounds large items up and
    drops small ones at a threshold; the second snaps lengths to multiples of capacity/(k+1).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    items, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    small = np.arange(0, capacity // 2 + 1)
    # threshold e: lengths above capacity-e count as full, those below e as nothing
    full = items[-1] - items[capacity - small + 1]
    middle = mass[capacity - small + 1] - mass[small]
    best = int((-(-(full * capacity + middle) // capacity)).max())
    for k in range(1, 100):
        whole = size * (k + 1) % capacity == 0
        # in units of capacity/(k*(k+1)), to stay with integers
        mapped = np.where(whole, size * (k + 1) * k // capacity, size * (k + 1) // capacity * (k + 1))
        best = max(best, int(-(-int((count * mapped).sum()) // (k * (k + 1)))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the bins' fill. Rooms are found through a bit mask of the sizes left."""
    bins, offsets, fill = np.empty(len(lengths), np.int32), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for n in np.argsort(-lengths, kind="stable"):
        size = int(lengths[n])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[n], offsets[n] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            if not by_room[left]:
                mask |= 1 << left
            by_room[left].append(b)
    return bins, offsets, fill


def _pack_task(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        n, task = len(lengths), TaskContext.get().partitionId()
        added = {
            "task": np.full(n, task, np.int32), "bin": bins, "offset": offsets, "fill": np.array(fill, np.int32)[bins],
            "bins": np.full(n, len(fill), np.int32), "bound": np.full(n, lower_bound(lengths, capacity), np.int32),
        }
        for name, column in added.items():
            table = table.append_column(name, pa.array(column))
        yield from table.to_batches(max_chunksize=20_000)

    return pack


def pack(items: DataFrame, capacity: int, per_task: int = 50_000) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``, and the certificate: part, bins, bound.

    ``per_task``: mean pieces a task packs. Rounds go on until one saves no sequence. Each part, the pieces that one
    task packed in one round, has ``bins`` sequences where any packing of the part needs at least ``bound``; after a
    later round took the poorly filled sequences out, ``bins`` and ``bound`` still are those of the whole part.
    """
    numbered = materialize(items.withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = numbered.count()

    def packed(rows: DataFrame, size: int, salt: int, name: str) -> DataFrame:
        dealt = rows.withColumn("_deal", F.xxhash64(F.lit(salt), "row")).repartition(max(1, -(-size // per_task)), "_deal").drop("_deal")
        return materialize(dealt.mapInArrow(_pack_task(capacity), _PACKED), name)

    done, open_rows, turn = [], packed(numbered, n, 0, "packed"), 0
    columns = numbered.columns
    while True:
        again = (F.col("bins") > F.col("bound")) | (F.col("fill") <= capacity // 2)
        bins = F.count_distinct("task", "bin")
        count, old = open_rows.filter(again).agg(F.count(F.lit(1)), bins).first()
        if old < 2:
            break
        turn += 1
        retry = packed(open_rows.filter(again).select(*columns), count, turn, "repacked")
        if retry.agg(bins).first()[0] >= old:
            break
        done.append((turn - 1, open_rows.filter(~again)))
        open_rows = retry
    done.append((len(done), open_rows))
    result = None
    for turn, rows in done:
        part = F.lit(turn).cast("long") * (1 << 52) + F.col("task").cast("long") * (1 << 31)
        chosen = rows.select(*[c for c in columns if c != "row"], (part + F.col("bin")).alias("sequence_id"), "offset", part.alias("part"), "bins", "bound")
        result = chosen if result is None else result.unionByName(chosen)
    return result
