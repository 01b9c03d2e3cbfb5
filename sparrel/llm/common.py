"""Shared helpers: scratch tables in the cluster's shared folder, size-checked broadcasts, file access."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_created: list[str] = []

T = TypeVar("T")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pafs.LocalFileSystem(), uri


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        _created.append(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    _created.append(path)
    return path


@atexit.register
def _remove() -> None:
    for uri in _created:
        fs, path = file_system(uri)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends there, its size is known.

    The write's shuffle files go when it ends, since nothing reads them again. Rows go to Python workers in batches
    of at most 2000, so that whole texts fit beside what the workers hold.
    """
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, name)
    rows = int(spark.conf.get(_BATCH_ROWS, "10000"))
    wanted = {_CLEAN_UP: "true", _BATCH_ROWS: str(min(rows, 2000) if rows > 0 else 2000)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    for folder in {uri.rsplit("/", 1)[0] for uri in table.inputFiles()}:
        fs, path = file_system(folder)
        fs.delete_dir(path)


def bytes_of(table: DataFrame) -> int:
    """Size in bytes of the files of a materialized table."""
    total = 0
    for uri in table.inputFiles():
        fs, path = file_system(uri)
        total += fs.get_file_info(path).size
    return total


def broadcast_within(table: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Hint a broadcast of a materialized table if its files are within ``limit`` bytes; else leave it to the planner."""
    return F.broadcast(table) if bytes_of(table) <= limit else table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_resource: list = []


def worker_resource(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: one resource at a time, so those of earlier stages go."""
    if not _resource or _resource[0] != key:
        free_worker()
        _resource[:] = key, make()
    return _resource[1]


def free_worker() -> None:
    """Forget the worker's resource and return freed memory to the system where the C library can."""
    _resource.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
