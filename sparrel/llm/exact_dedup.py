"""Exact deduplication by Grace hashing.

Every task first folds its own rows into an open-addressing table that compares complete content,
so a group of copies leaves a task once however large it is. The survivors are dealt by hash, and
the same table merges them. A table that outgrows its byte budget partitions its records to spill
files in the shared folder by further hash bits and treats each file the same way, until it fits.

Defined cases: a null text counts as the empty text; null ids are ignored by the minimum, and a
group with null ids only keeps null; rows that repeat the smallest id of a group are one document
and stay together; an empty table gives an empty result; other columns ride along, whatever their
names, except those named like a result column.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import broadcast_within, file_system, free_worker, materialize, scratch_folder

_HEAD = struct.Struct("<QqqBI")
_NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    r"""Text with each run of [\x20\x09-\x0D] as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class GraceTable:
    """Folds (hash, content, smallest id, count) records into groups of equal content."""

    def __init__(self, budget: int, spill: str, fanout: int = 16, depth: int = 0) -> None:
        self.budget, self.spill, self.fanout, self.depth = budget, spill, fanout, depth
        self.files: list | None = None
        self._reset()

    def _reset(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.bytes = 0

    def _place(self, h: int, content: bytes | None) -> int:
        """The slot of equal content, or the free slot where it belongs. None fits no content."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (n := self.slots[at]) >= 0:
            if self.hashes[n] == h and self.contents[n] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, h: int, content: bytes, smallest: int, count: int) -> None:
        if self.files is not None:
            self._write(h, content, smallest, count)
            return
        at = self._place(h, content)
        if (n := self.slots[at]) >= 0:
            self.ids[n] = min(self.ids[n], smallest)
            self.counts[n] += count
            return
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.ids.append(smallest)
        self.counts.append(count)
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        # Sixteen levels read all 64 bits: what is left together then has one hash and, being keyed by SHA-256, one content.
        if self.bytes > self.budget and len(self.hashes) > 1 and self.depth < 16:
            self._partition()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        for n, h in enumerate(self.hashes):
            self.slots[self._place(h, None)] = n

    def _partition(self) -> None:
        fs, path = file_system(self.spill)
        fs.create_dir(path, recursive=True)
        self.names = [f"{path}/{uuid.uuid4().hex}" for _ in range(self.fanout)]
        self.files = [fs.open_output_stream(n, buffer_size=1 << 16) for n in self.names]
        for record in zip(self.hashes, self.contents, self.ids, self.counts, strict=True):
            self._write(*record)
        self._reset()

    def _write(self, h: int, content: bytes, smallest: int, count: int) -> None:
        bits = (h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (4 * self.depth)
        self.files[bits % self.fanout].write(_HEAD.pack(h, smallest, count, 0, len(content)) + content)

    def groups(self) -> Iterator[tuple[int, bytes, int, int]]:
        """All groups; spill files go one by one as they are read."""
        if self.files is None:
            yield from zip(self.hashes, self.contents, self.ids, self.counts, strict=True)
            return
        fs, _ = file_system(self.spill)
        for f in self.files:
            f.close()
        for name in self.names:
            part = GraceTable(self.budget, self.spill, self.fanout, self.depth + 1)
            with fs.open_input_stream(name, buffer_size=1 << 16) as f:
                while head := f.read(_HEAD.size):
                    h, smallest, count, _, size = _HEAD.unpack(head)
                    part.add(h, f.read(size), smallest, count)
            fs.delete_file(name)
            yield from part.groups()

    def close(self) -> None:
        """Remove what a broken-off task left behind."""
        fs, path = file_system(self.spill)
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)


_GROUPS = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("smallest", pa.int64()), ("n", pa.int64())])


def _fold(budget: int, spill: str, with_content: bool):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        own = f"{spill}/{uuid.uuid4().hex}"
        table = GraceTable(budget, own)
        try:
            for batch in batches:
                digests, contents = batch.column("digest"), batch.column("content")
                ids, counts = batch.column("smallest").to_pylist(), batch.column("n").to_pylist()
                for n, smallest in enumerate(ids):
                    digest = digests[n].as_py()
                    content = contents[n].as_py()
                    # The digest travels in front of the content: the table compares both.
                    table.add(int.from_bytes(digest[:8], "little"), digest + content, _NO_ID if smallest is None else smallest, counts[n])
            held, size = [], 0
            for _, content, smallest, n in table.groups():
                if not with_content and n == 1:
                    continue
                held.append((content[:32], content[32:] if with_content else b"", None if smallest == _NO_ID else smallest, n))
                size += len(content) if with_content else 64
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _GROUPS, strict=True)], schema=_GROUPS)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _GROUPS, strict=True)], schema=_GROUPS)
        finally:
            table.close()

    return fold


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20) -> DataFrame:
    """Groups of two or more rows with equal normalised text: (digest, smallest, n). ``budget``: bytes of a table in memory."""
    spark = docs.sparkSession
    spill = scratch_folder(spark, "grace")
    content = normalised(F.col(text_col))
    rows = docs.select(content.alias("c"), F.col(id_col).cast("long").alias("smallest"))
    rows = rows.select(F.unhex(F.sha2("c", 256)).alias("digest"), F.col("c").cast("binary").alias("content"), "smallest", F.lit(1).cast("long").alias("n"))
    schema = "digest binary, content binary, smallest long, n long"
    local = rows.mapInArrow(_fold(budget, spill, True), schema)
    # Each distinct text comes once from each task, so a bucket holds no hot group.
    dealt = local.repartition(F.col("digest"))
    return dealt.mapInArrow(_fold(budget, spill, False), schema).select("digest", "smallest", "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with keep_id, group_size, kept and text_sha256; columns of these names in ``docs`` are replaced."""
    added = ("keep_id", "group_size", "kept", "text_sha256")
    names = [c for c in docs.columns if c not in added]
    # Names of this join that no column of the user's can have.
    own, digest, smallest, count = (f"{name}_{uuid.uuid4().hex}" for name in ("own", "digest", "smallest", "count"))
    groups = broadcast_within(materialize(copy_groups(docs, id_col, text_col, budget), "copies")).toDF(digest, smallest, count)
    rows = docs.select(*[F.col(_quoted(c)) for c in names], F.unhex(F.sha2(normalised(F.col(_quoted(text_col))), 256)).alias(own))
    joined = rows.join(groups, F.col(own) == F.col(digest), "left")
    keep = F.when(F.col(count).isNull(), F.col(_quoted(id_col))).otherwise(F.col(smallest))
    return joined.select(
        *[F.col(_quoted(c)) for c in names],
        keep.alias("keep_id"),
        F.coalesce(count, F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col(_quoted(id_col))).alias("kept"),
        F.lower(F.hex(own)).alias("text_sha256"),
    )
