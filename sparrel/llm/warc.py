"""WARC archives as a Python data source, and the revisit records that deduplicate them.

Each record is a gzip member of its own whose extra field ``sl`` gives its compressed and plain
size, so a reader inflates a member only up to its headers, tests them, and seeks past the payload
if the record or its payload is not wanted. Members without the field are inflated to their end.

Reader options: ``payload`` (``true`` to return payloads), ``verify`` (``true`` to compare each
response's payload with its digest), ``partitionBytes`` (files per partition), ``where`` (JSON of
the wanted values of record_type, record_id, target_uri, payload_digest or refers_to, tested on
headers), ``push`` (``true`` to take equality and IN filters on those columns from the query itself).
Spark 4.1 keeps the filters that one query pushed into a Python source for later queries of the same
frame, which then lose rows: with ``push`` a loaded frame is good for one filter. ``where`` is not.
Writer: one commit lists the files that make up the archive, so files of lost attempts are ignored.

Defined cases: a null or empty html is an empty payload, a null url has no target header, other urls
come back as they were, outer spaces, line breaks and angle brackets included; a null page id is
named ``none`` and comes back null; rows that repeat an id are records of their own; an empty table
is an archive without files; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from sparrel.llm.common import broadcast_within, file_system, materialize, scratch_folder

SCHEMA = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"
_FIELDS = ["record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload"]
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_ARROW = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in _FIELDS])
# Gzip member with an extra field, subfield "sl" of two 32-bit sizes, and the revisit profile's address.
_GZIP = struct.Struct("<4sIBBH2sHII")
_EXTRA = b"\x1f\x8b\x08\x04"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "_manifest.json"
#: A member's headers are looked for in so many compressed bytes, and plain ones, at first.
_PEEK = 4096
_ROLL = 128 << 20


def _clean(value: str) -> str:
    """Header values hold no line breaks: they are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value or "%0" in value or "%25" in value else value


def _restore(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if "%" in value else value


def encode_record(record_id: str, record_type: str, target_uri: str | None, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """One gzip member. A revisit keeps the HTTP header block with the payload's length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_clean(record_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {_clean(target_uri)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_clean(refers_to)}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    plain = "\r\n".join(head).encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    whole = _GZIP.size + len(body) + 8
    return _GZIP.pack(_EXTRA, 0, 4, 255, 12, b"sl", 8, whole, len(plain) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.removeprefix(" ")
    return found


@dataclass
class Record:
    headers: dict[str, str]
    _rest: object

    def block(self) -> bytes:
        """The record's block; inflates the rest of the member."""
        return self._rest(int(self.headers["content-length"]))


def read_members(file, size: int) -> Iterator[Record]:
    """Records of a seekable gzip WARC file, headers first. A record's block must be read before the next record."""
    at = 0
    while at < size:
        file.seek(at)
        data = file.read(_PEEK)
        known = None
        if data[:4] == _EXTRA and len(data) >= _GZIP.size and data[12:14] == b"sl":
            known = _GZIP.unpack_from(data)[7]
        inflate = zlib.decompressobj(31)
        plain = bytearray(inflate.decompress(data, _PEEK))
        read = len(data)

        def more() -> bool:
            nonlocal read
            if inflate.eof:
                return False
            if held := inflate.decompress(inflate.unconsumed_tail, 1 << 18):
                plain.extend(held)
                return True
            if inflate.eof:
                return False
            file.seek(at + read)
            chunk = file.read(1 << 18)
            if not chunk:
                raise ValueError("a gzip member is cut short")
            read += len(chunk)
            plain.extend(inflate.decompress(chunk, 1 << 18))
            return True

        while (end := plain.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record has no end of headers")

        def rest(length: int) -> bytes:
            while len(plain) < end + 4 + length:
                if not more():
                    raise ValueError("a record is shorter than its length")
            return bytes(plain[end + 4 : end + 4 + length])

        yield Record(_parse(bytes(plain[:end])), rest)
        if known is None:
            while more():
                plain.clear()
            known = read - len(inflate.unused_data)
        at += known


def _list(uri: str) -> list[tuple[str, int]]:
    """Files of an archive: those of its manifest if it has one, else all .warc.gz files."""
    fs, path = file_system(uri)
    infos = fs.get_file_info(pa.fs.FileSelector(path)) if fs.get_file_info(path).type == pa.fs.FileType.Directory else [fs.get_file_info(path)]
    sizes = {i.path: i.size for i in infos}
    if f"{path}/{_MANIFEST}" in sizes:
        with fs.open_input_stream(f"{path}/{_MANIFEST}") as f:
            return [(f"{path}/{n}", sizes[f"{path}/{n}"]) for n in json.loads(f.read())]
    return sorted((p, s) for p, s in sizes.items() if p.endswith(".warc.gz"))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.payload = options.get("payload", "false").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.bytes = int(options.get("partitionbytes", 32 << 20))
        wanted = json.loads(options.get("where", "{}"))
        if unknown := set(wanted) - set(_HEADERS):
            raise ValueError(f"no header predicates on {sorted(unknown)}")
        self.tests = [(name, frozenset(values)) for name, values in wanted.items()]

    def partitions(self):
        groups: list[Files] = []
        room = 0
        for name, size in _list(self.uri):
            if room < size or not groups:
                groups.append(Files([]))
                room = self.bytes
            groups[-1].files.append((name, size))
            room -= size
        return groups or [Files([])]

    @staticmethod
    def _value(headers: dict[str, str], name: str) -> str | None:
        value = headers.get(_HEADERS[name])
        if value is None or name == "target_uri":
            return value and _restore(value)
        value = value.strip()
        if name == "payload_digest":
            return value.removeprefix("sha256:")
        return value if name == "record_type" else _restore(value[1:-1] if value[:1] == "<" else value)

    def read(self, partition):
        fs, _ = file_system(self.uri)
        rows, held = [], 0
        for name, size in partition.files:
            with fs.open_input_file(name) as f:
                for record in read_members(f, size):
                    if any(self._value(record.headers, n) not in wanted for n, wanted in self.tests):
                        continue
                    row = {n: self._value(record.headers, n) for n in _HEADERS} | {"payload": None, "payload_bytes": None}
                    if row["record_type"] in ("response", "revisit"):
                        full = row["record_type"] == "response" and (self.payload or self.verify)
                        block = record.block() if full or row["record_type"] == "revisit" else None
                        if block is None:
                            row["payload_bytes"] = self._length(record)
                        else:
                            http, _, payload = block.partition(b"\r\n\r\n")
                            row["payload_bytes"] = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                            if full and self.verify and (len(payload) != row["payload_bytes"] or hashlib.sha256(payload).hexdigest() != row["payload_digest"]):
                                raise ValueError(f"payload of {row['record_id']} does not match its digest")
                            if full and self.payload:
                                row["payload"] = payload
                                held += len(payload)
                    rows.append(row)
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    @staticmethod
    def _length(record: Record) -> int:
        """A response's payload length without its payload: block length less HTTP header block."""
        total, step = int(record.headers["content-length"]), 256
        while True:
            start = record._rest(min(step, total))
            if (end := start.find(b"\r\n\r\n")) >= 0:
                return total - end - 4
            if step >= total:
                raise ValueError("a response has no HTTP header block")
            step *= 4


class _PushReader(_Reader):
    """Takes equality and IN filters on header columns out of the query; Spark applies the others."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in _HEADERS and isinstance(f, (EqualTo, In)):
                wanted = f.value if isinstance(f, In) else [f.value]
                self.tests.append((name, frozenset(v for v in wanted if v is not None)))
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.uri, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        fs, base = file_system(self.uri)
        names, stream, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if stream is None or size >= _ROLL:
                    if stream is not None:
                        stream.close()
                    fs.create_dir(base, recursive=True)
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    stream, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                member = encode_record(row["record_id"], row["record_type"], row["target_uri"], row["payload_digest"], row["payload_bytes"], row["refers_to"], row["payload"] or b"")
                stream.write(member)
                size += len(member)
        if stream is not None:
            stream.close()
        return _Written(names)

    def commit(self, messages):
        fs, base = file_system(self.uri)
        fs.create_dir(base, recursive=True)
        names = [n for m in messages if m for n in m.names]
        if not self.overwrite and fs.get_file_info(f"{base}/{_MANIFEST}").type == pa.fs.FileType.File:
            with fs.open_input_stream(f"{base}/{_MANIFEST}") as f:
                names = json.loads(f.read()) + names
        with fs.open_output_stream(f"{base}/{_MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        fs, base = file_system(self.uri)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{base}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        options = dict(self.options)
        return (_PushReader if options.get("push", "false").lower() == "true" else _Reader)(options)

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def with_revisits(records: DataFrame, key: str, least: int = 100) -> DataFrame:
    """Add record_type and refers_to to rows with ``key``, payload_bytes and payload_digest.

    Of equal payloads of at least ``least`` bytes the row with the smallest key is the response and
    the others revisit it. Rows that repeat the smallest key are responses; a null key is never the
    smallest. Only digests and keys are grouped, and folded before the shuffle.
    """
    long = records.filter(F.col("payload_bytes") >= least).select("payload_digest", F.col(key).alias("_key"))
    groups = long.groupBy("payload_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _first IS NOT NULL")
    groups = broadcast_within(materialize(groups.select(F.col("payload_digest").alias("_digest"), "_first"), "revisits"))
    joined = records.join(groups, F.col("payload_digest") == F.col("_digest"), "left")
    again = F.coalesce(~F.col(key).eqNullSafe(F.col("_first")), F.lit(False)) & F.col("_first").isNotNull()
    return joined.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first"))}).drop("_digest", "_first")


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> None:
    """Write a record per page. A null html is an empty payload, a null url has no target header."""
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), text.alias("text"))
    records = rows.withColumns({"payload_bytes": F.octet_length("text").cast("long"), "payload_digest": F.sha2("text", 256)})
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    out = with_revisits(records, "page_id", least).select(
        name("page_id").alias("record_id"), "record_type", "target_uri", "payload_bytes", "payload_digest",
        F.when(F.col("refers_to").isNotNull(), name("refers_to")).alias("refers_to"), F.col("text").cast("binary").alias("payload"),
    )
    register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, where: dict[str, list[str]] | None = None, payload: bool = False, verify: bool = False, push: bool = False) -> DataFrame:
    """Records of an archive; ``where`` maps header columns to the values wanted; ``push`` lets one query push its filters."""
    register(spark)
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"payload": str(payload), "verify": str(verify), "push": str(push), "where": json.dumps(where or {})}
    return spark.read.format("warc").options(**options).load(path)


def pages_round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Two reads by record type: responses with their payloads checked, revisits from headers, past all other payloads.
    """
    path = f"{scratch_folder(pages.sparkSession, 'warc')}"
    archive_pages(pages, path)
    number = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    spark = pages.sparkSession
    back = read_archive(spark, path, {"record_type": ["response"]}, verify=True).union(read_archive(spark, path, {"record_type": ["revisit"]}))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
