"""Slotted block files: fixed-size blocks of packed rows, zero padding, and a row count at the end.

Numbers are little-endian; strings are UTF-8 closed by a zero byte. Blocks decode independently,
so a file splits at any multiple of the block size. Convert to Parquet before querying often.
"""

from __future__ import annotations

import struct
from collections.abc import Collection, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparrel.functions.types import F32, F64, I32, I64, STRING, tag_of

_FORMATS = {I32: struct.Struct("<i"), I64: struct.Struct("<q"), F32: struct.Struct("<f"), F64: struct.Struct("<d")}
_COUNT = struct.Struct("<H")


def decode_block(block: bytes, tags: list[str], wanted: Collection[int] | None = None) -> Iterator[tuple]:
    """The rows of a block; of the columns at ``wanted`` only, if given, in stored order. Other values are skipped, and so is all behind the last wanted one of rows of fixed width."""
    (rows,) = _COUNT.unpack_from(block, len(block) - _COUNT.size)
    keep = [wanted is None or n in wanted for n in range(len(tags))]
    if STRING not in tags:
        pad = [_FORMATS[tag].format[1:] if own else f"{_FORMATS[tag].size}x" for tag, own in zip(tags, keep, strict=True)]
        row = struct.Struct("<" + "".join(pad))
        yield from row.iter_unpack(block[: rows * row.size])
        return
    at = 0
    for _ in range(rows):
        row = []
        for tag, own in zip(tags, keep, strict=True):
            if tag == STRING:
                end = block.index(0, at)
                if own:
                    row.append(block[at:end].decode())
                at = end + 1
            else:
                if own:
                    row.append(_FORMATS[tag].unpack_from(block, at)[0])
                at += _FORMATS[tag].size
        yield tuple(row)


def encode_row(row: Iterable, tags: list[str]) -> bytes:
    out = bytearray()
    for value, tag in zip(row, tags, strict=True):
        if tag == STRING:
            raw = value.encode()
            if 0 in raw:
                raise ValueError("a string holds the terminator byte")
            out += raw + b"\0"
        else:
            out += _FORMATS[tag].pack(value)
    return bytes(out)


def encode_blocks(rows: Iterable[Iterable], tags: list[str], block_size: int = 4096) -> Iterator[bytes]:
    """Pack rows in order; a row that does not fit an empty block is an error."""
    room = block_size - _COUNT.size
    body, held = bytearray(), 0
    for raw in (encode_row(r, tags) for r in rows):
        if len(raw) > room:
            raise ValueError(f"a row of {len(raw)} bytes does not fit a block of {block_size}")
        if len(body) + len(raw) > room or held == 0xFFFF:
            yield bytes(body.ljust(room, b"\0")) + _COUNT.pack(held)
            body, held = bytearray(), 0
        body += raw
        held += 1
    if held:
        yield bytes(body.ljust(room, b"\0")) + _COUNT.pack(held)


def _tags(schema: T.StructType) -> list[str]:
    tags = [tag_of(f.dataType) for f in schema]
    if not set(tags) <= {*_FORMATS, STRING}:
        raise ValueError("block files hold the five scalar types only")
    return tags


def encode_frame(df: DataFrame, block_size: int = 4096) -> DataFrame:
    """The rows of each partition as blocks, in one binary column ``block``."""
    tags = _tags(df.schema)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in batch.itertuples(index=False, name=None))
        blocks = encode_blocks(rows, tags, block_size)
        while some := list(islice(blocks, 1000)):
            yield pd.DataFrame({"block": some})

    return df.mapInPandas(encode, "block binary")


def decode_frame(blocks: DataFrame, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """The rows of blocks in a binary column ``block``; with ``columns``, only those are decoded and leave the Python worker."""
    tags = _tags(schema)
    if unknown := set(columns or ()) - set(schema.names):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    wanted = [n for n, name in enumerate(schema.names) if columns is None or name in columns]
    some = T.StructType([schema[n] for n in wanted])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for b in batch["block"] for r in decode_block(bytes(b), tags, wanted)], columns=some.names)

    rows = blocks.select("block").mapInPandas(decode, some)
    return rows if columns is None else rows.select(*[f"`{c}`" for c in columns])


def read_blocks(spark: SparkSession, path: str, schema: T.StructType, block_size: int = 4096, columns: list[str] | None = None) -> DataFrame:
    """Rows of a block file, or of files in a folder: each must hold whole blocks; an empty file is an empty table. Fixed-length records are the one input Spark offers as an RDD only."""
    _tags(schema)
    if block_size <= 0:
        raise ValueError(f"a block size of {block_size}")
    for name, length in spark.read.format("binaryFile").load(path).filter(f"length % {block_size} <> 0").select("path", "length").head(5):
        raise ValueError(f"{name} holds {length} bytes, not whole blocks of {block_size}")
    raw = spark.sparkContext.binaryRecords(path, block_size).map(lambda b: (bytearray(b),))
    return decode_frame(spark.createDataFrame(raw, "block binary"), schema, columns)
