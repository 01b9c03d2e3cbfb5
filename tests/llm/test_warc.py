import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from sparrel.llm import warc

PAGES = "page_id long, url string, html string, record_type string, payload_digest int"
LONG = "é" * 60
ROWS = [(5, "http://a/%0A?x=%25", LONG, "", 1), (3, None, LONG, None, 1), (9, "u\nv", "short", "", 1), (8, "u", "short", "", 1), (1, "u", None, "", 1),
        (None, "n", LONG, "", 1), (3, "again", LONG, "", 1), (4, "<i> ", "", "", 1), (6, "  ", "", "", 1), (20, "big", "x" * 3_000_000, "", 1), (21, "big", "x" * 3_000_000, "", 1), (22, "", "", "", 1)]


def test_round_trip(spark):
    got = sorted(map(tuple, warc.pages_round_trip(spark.createDataFrame(ROWS, PAGES)).collect()), key=repr)
    want = []
    for page, _, html, *_ in ROWS:
        raw = (html or "").encode()
        same = [p for p, _, h, *_ in ROWS if h == html and p is not None]
        first = min(same)
        revisit = len(raw) >= 100 and page != first
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.pages_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_reader(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.archive_pages(spark.createDataFrame(ROWS, PAGES), path)
    (tmp_path / "a" / "lost.warc.gz").write_bytes(b"left by a lost attempt")
    full = warc.read_archive(spark, path, payload=True, verify=True)
    assert sorted(r.payload.decode() for r in full.filter("record_type = 'response'").collect()) == sorted([LONG, LONG, "short", "short", "", "", "", "", "x" * 3_000_000])
    assert {r.target_uri for r in full.collect()} == {u for _, u, *_ in ROWS}
    plain = warc.read_archive(spark, path)
    assert plain.filter(F.col("record_id").isin("urn:page:20", "urn:page:9")).count() == 2 and plain.count() == len(ROWS)
    assert plain.filter("payload_bytes > 1000").count() == 2
    some = warc.read_archive(spark, path, {"record_type": ["revisit"], "target_uri": ["n", "u"]}, payload=True)
    assert [(r.record_id, r.payload) for r in some.collect()] == [("urn:page:none", None)]
    assert warc.read_archive(spark, path, {"record_id": ["urn:page:20", "urn:page:9"]}).count() == 2
    with pytest.raises(Exception, match="no header predicates"):
        warc.read_archive(spark, path, {"payload": ["x"]}).count()
    for f in (tmp_path / "a").glob("*.warc.gz"):
        if f.name != "lost.warc.gz":
            assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_members_without_sizes_and_broken_ones(tmp_path):
    member = warc.encode_record("a", "response", "u", "d", 3, None, b"abc")
    foreign = gzip.compress(gzip.decompress(member))
    both = foreign + member + foreign
    (tmp_path / "f").write_bytes(both)
    with open(tmp_path / "f", "rb") as f:
        assert [r.block()[-3:] for r in warc.read_members(f, len(both))] == [b"abc"] * 3
        assert [r.headers["warc-type"] for r in warc.read_members(f, len(both))] == ["response"] * 3
    (tmp_path / "f").write_bytes(member[:-20])
    with open(tmp_path / "f", "rb") as f, pytest.raises(ValueError):
        [r.block() for r in warc.read_members(f, len(member) - 20)]


def test_payloads_that_do_not_match_raise(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(warc.encode_record("a", "response", "u", "0" * 64, 3, None, b"abc"))
    assert warc.read_archive(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, str(tmp_path), verify=True).collect()


class Counted:
    def __init__(self, file):
        self.file, self.bytes, self.seek = file, 0, file.seek

    def read(self, n):
        data = self.file.read(n)
        self.bytes += len(data)
        return data


def test_unwanted_payloads_are_neither_read_nor_inflated(tmp_path):
    noise = random.Random(1).randbytes(1 << 20)
    members = [warc.encode_record(str(n), "response", "u", "d", len(p), None, p) for n, p in enumerate([noise, b"x" * (1 << 20), noise])]
    (tmp_path / "f").write_bytes(b"".join(members))
    with open(tmp_path / "f", "rb") as f:
        counted, inflated = Counted(f), 0
        for record in warc.read_members(counted, sum(map(len, members))):
            inflated += len(record._rest.__closure__[[*record._rest.__code__.co_freevars].index("plain")].cell_contents)
        assert counted.bytes <= 3 * 4096 and inflated <= 3 * 4096
    with open(tmp_path / "f", "rb") as f:
        assert [len(r.block()) for r in warc.read_members(f, sum(map(len, members)))] == [int(r.headers["content-length"]) for r in warc.read_members(open(tmp_path / "f", "rb"), sum(map(len, members)))]


def test_filters_of_the_query_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.archive_pages(spark.createDataFrame(ROWS, PAGES), path)
    for test, wanted in [("record_type = 'revisit'", 3), ("target_uri IN ('u', 'n') AND payload_bytes > 10", 1), ("record_id = 'urn:page:20' OR payload_bytes < 1", 5)]:
        kept = warc.read_archive(spark, path, push=True).filter(test)
        assert kept.count() == wanted == warc.read_archive(spark, path).filter(test).count()
    warc.register(spark)
    reader = warc._PushReader({"path": path})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("n", "u")), EqualTo(("payload_bytes",), 3)]))
    assert left == [EqualTo(("payload_bytes",), 3)]
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [r["record_id"] for r in rows] == ["urn:page:none"]
