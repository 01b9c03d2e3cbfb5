"""Token ids in binary shards: patched frame-of-reference blocks.

A shard holds documents in ascending id order. Ids are cut into blocks of 1024. A block stores its
minimum, the differences packed at the width that 95 % of them fit, and the high bits of the others
in an exception list. The trailer indexes block starts and documents, so a reader decodes the
blocks of any document alone.

Layout: magic; blocks; trailer (block starts, then doc ids, null marks, starts, lengths);
8-byte trailer position; magic. A block: minimum u4, count u2, exceptions u2, width u1, packed
words, exception places u2, exception high bits u4. All little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrel.llm.common import file_system, materialize, scratch_folder
from sparrel.llm.tokens import encoder

MAGIC = b"PFORTOK1"
BLOCK = 1024
GROUP = 64
_HEAD = struct.Struct("<IHHB")
_TAIL = struct.Struct("<QQQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width to rows of BLOCK/64*width words."""
    v = values.reshape(len(values), BLOCK // GROUP, GROUP).astype("<u8")
    out = np.zeros((len(values), BLOCK // GROUP, max(width, 1)), "<u8")
    for n in range(GROUP if width else 0):
        word, bit = divmod(n * width, 64)
        out[:, :, word] |= v[:, :, n] << np.uint64(bit)
        if bit + width > 64:
            out[:, :, word + 1] |= v[:, :, n] >> np.uint64(64 - bit)
    return out[:, :, :width].reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK // GROUP, GROUP), "<u8")
    w = words.reshape(len(words), BLOCK // GROUP, width) if width else None
    for n in range(GROUP if width else 0):
        word, bit = divmod(n * width, 64)
        x = w[:, :, word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | (w[:, :, word + 1] << np.uint64(64 - bit))
        out[:, :, n] = x & np.uint64((1 << width) - 1)
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = 0.95) -> list[bytes]:
    """Blocks of unsigned 32-bit ids; the last may be short (its padding repeats its minimum)."""
    if not len(ids):
        return []
    count = -(-len(ids) // BLOCK)
    grid = np.empty(count * BLOCK, "<u4")
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[(count - 1) * BLOCK :].min()
    grid = grid.reshape(count, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    chosen = np.partition(rest, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))]
    widths = np.array([int(x).bit_length() for x in chosen])
    blocks: list[bytes] = [b""] * count
    for width in np.unique(widths):
        rows = np.nonzero(widths == width)[0]
        part = rest[rows]
        packed = _pack(part & np.uint32((1 << int(width)) - 1), int(width))
        high = part.astype("<u8") >> np.uint64(width)
        for n, row in enumerate(rows):
            places = np.nonzero(high[n])[0]
            size = BLOCK if row < count - 1 else len(ids) - row * BLOCK
            blocks[row] = _HEAD.pack(low[row], size, len(places), width) + packed[n].tobytes() + places.astype("<u2").tobytes() + high[n][places].astype("<u4").tobytes()
    return blocks


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks at the given starts, in order."""
    if not len(starts):
        return np.empty(0, "<u4")
    heads = [_HEAD.unpack_from(raw, s) for s in starts]
    out = np.empty((len(starts), BLOCK), "<u4")
    widths = np.array([h[3] for h in heads])
    for width in np.unique(widths):
        rows, size = np.nonzero(widths == width)[0], BLOCK * int(width) // 64
        words = np.stack([np.frombuffer(raw, "<u8", size, starts[r] + _HEAD.size) for r in rows])
        values = _unpack(words, int(width))
        for n, r in enumerate(rows):
            low, _, odd, _ = heads[r]
            if odd:
                at = starts[r] + _HEAD.size + size * 8
                places = np.frombuffer(raw, "<u2", odd, at)
                values[n, places] |= np.frombuffer(raw, "<u4", odd, at + 2 * odd).astype("<u8") << np.uint64(width)
            out[r] = values[n] + low
    return np.concatenate([out[:-1].reshape(-1), out[-1, : heads[-1][1]]])


class ShardWriter:
    """Streams documents into one shard; at most ``chunk`` blocks of ids wait in memory."""

    def __init__(self, stream, chunk: int = 256) -> None:
        self.stream, self.chunk = stream, chunk * BLOCK
        self.at, self.total, self.waiting, self.held = len(MAGIC), 0, [], 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, bool, int, int]] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.total, len(ids)))
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.chunk:
            self._flush(self.held - self.held % BLOCK)

    def _flush(self, size: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        for first in range(0, size, self.chunk):
            for block in encode_blocks(ids[first : min(first + self.chunk, size)]):
                self.starts.append(self.at)
                self.stream.write(block)
                self.at += len(block)
        self.waiting, self.held = [ids[size:].copy()], len(ids) - size

    def close(self) -> None:
        self._flush(self.held)
        self.stream.write(np.array(self.starts, "<u8").tobytes())
        for column, kind in zip(zip(*self.docs, strict=True) if self.docs else [()] * 4, ("<i8", "u1", "<u8", "<u8"), strict=True):
            self.stream.write(np.array(column, kind).tobytes())
        self.stream.write(_TAIL.pack(len(self.starts), len(self.docs), self.at) + MAGIC)
        self.stream.close()


class ShardReader:
    """Random access to a shard's documents."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.size()
        n_blocks, n_docs, self.end = _TAIL.unpack(self._at(end - len(MAGIC) - _TAIL.size, _TAIL.size))
        if self._at(0, len(MAGIC)) != MAGIC or self._at(end - len(MAGIC), len(MAGIC)) != MAGIC:
            raise ValueError("not a token shard")
        trailer = self._at(self.end, 8 * n_blocks + 25 * n_docs)
        self.starts = np.frombuffer(trailer, "<u8", n_blocks).astype(np.int64)
        at = 8 * n_blocks
        self.doc_ids = np.frombuffer(trailer, "<i8", n_docs, at)
        self.nulls = np.frombuffer(trailer, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self.places = np.frombuffer(trailer, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.sizes = np.frombuffer(trailer, "<u8", n_docs, at + 17 * n_docs).astype(np.int64)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def ids(self, start: int, size: int) -> np.ndarray:
        """Ids from place ``start`` on, through the block index."""
        if not size:
            return np.empty(0, "<u4")
        first, last = start // BLOCK, (start + size - 1) // BLOCK
        ends = [*self.starts[first + 1 : last + 2]] or []
        stop = int(ends[last - first]) if last + 1 < len(self.starts) else self.end
        raw = self._at(int(self.starts[first]), stop - int(self.starts[first]))
        found = decode_blocks(raw, self.starts[first : last + 1] - self.starts[first])
        return found[start - first * BLOCK : start - first * BLOCK + size]

    def documents(self, about: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of all documents, decoding runs of about so many ids at once."""
        n = 0
        while n < len(self.sizes):
            stop = max(n + 1, int(np.searchsorted(self.places, self.places[n] + about)))
            start = int(self.places[n])
            run = self.ids(start, int(self.places[stop - 1] + self.sizes[stop - 1]) - start)
            for k in range(n, stop):
                yield k, run[self.places[k] - start : self.places[k] - start + self.sizes[k]]
            n = stop


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """Write all documents, one shard per range of ids; returns the manifest (shard, path, n_docs, n_ids, first).

    ``first`` counts the ids in all earlier shards. ``shard_bytes``: mean bytes of text and row of a shard, at any
    size of the table. Files of lost or repeated task attempts are in no manifest. Null ids come first; rows that
    repeat an id lie side by side, over several shards if they are many; a null text has no ids but the end id;
    an empty table has an empty manifest.
    """
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path = None, ""
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1)), strict=True):
                if writer is None:
                    fs, base = file_system(folder)
                    fs.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.tok"
                    writer = ShardWriter(fs.open_output_stream(path, buffer_size=1 << 20))
                writer.add(doc_id, np.concatenate([ids, tail]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [path.rsplit("/", 1)[1]], "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    # The row's place parts the rows of one id, however many there are.
    ranged = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(shards, "doc_id", "at").sortWithinPartitions("doc_id", "at")
    manifest = materialize(ranged.select("doc_id", "text").mapInArrow(write, "shard int, name string, n_docs long, n_ids long"), "manifest")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("shard", F.concat(F.lit(f"{folder}/"), "name").alias("path"), "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("first"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = file_system(path)
                with fs.open_input_file(base) as f:
                    shard = ShardReader(f)
                    crcs = np.empty(len(shard.sizes), np.int64)
                    for n, ids in shard.documents():
                        crcs[n] = zlib.crc32(ids.astype("<u4").tobytes())
                columns = [pa.array(shard.doc_ids, mask=shard.nulls), pa.array(shard.places + first), pa.array(shard.sizes), pa.array(crcs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A given number of partitions: adaptive execution would put the few rows of a manifest in one task.
    files = manifest.select("path", "first").repartition(max(1, manifest.count()))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    folder = scratch_folder(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, folder, tokenizer, end_id))
