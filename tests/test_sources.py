import json

import pytest
from pyspark.sql import functions as F

from sparrel import Catalog, Scan
from sparrel.operators.io_model import Geometry, io_report, request_costs
from sparrel.operators.stats import column_statistics, equi_depth_histogram, is_ordered, physically_ordered, uniform_sample
from sparrel.runner import Case, Mismatch, run_suite
from sparrel.sources.blocks import decode_block, encode_blocks, read_blocks
from sparrel.sources.delimited import catalog_of_folder, discover, parse_schema
from sparrel.sources.metadata import dump_catalog, load_schemas, table_entry
from sparrel.sources.row_text import format_float, protocol_lines

WORDS = "id|n|f|d|s|\nI32|i64|FLOAT32|FLOAT64|STRING|\n"


def folder(tmp_path, body):
    (tmp_path / "t.schema").write_text(WORDS)
    (tmp_path / "t.csv").write_text(body)
    return str(tmp_path)


def test_delimited(spark, tmp_path):
    catalog = catalog_of_folder(spark, folder(tmp_path, "1|2|0.5|1e3|x y|\n3|4|1.5|2|\n"), ["t"])
    assert [tuple(r) for r in catalog.table("t").collect()] == [(1, 2, 0.5, 1000.0, "x y"), (3, 4, 1.5, 2.0, "")]


@pytest.mark.parametrize("body", ["1|2|0.5|1\n", "\n", "1|2|0.5|1|a|b|\n", "x|2|0.5|1|a\n"])
def test_delimited_errors(spark, tmp_path, body):
    with pytest.raises(Exception, match="expected 5 fields|bad value"):
        catalog_of_folder(spark, folder(tmp_path, "1|2|0.5|1|a\n" + body), ["t"]).table("t").collect()


def test_schema_errors():
    for text in ("a|b\nI32\n", "a\nDATE\n", "a\n"):
        with pytest.raises(ValueError):
            parse_schema(text)


def test_blocks(spark, tmp_path):
    schema = parse_schema(WORDS)
    rows = [(n, n * 10**10, n / 2, n / 3, "é" * (n % 7)) for n in range(500)]
    tags = ["I32", "I64", "F32", "F64", "String"]
    blocks = list(encode_blocks(rows, tags, 256))
    assert {len(b) for b in blocks} == {256}
    assert [r for b in blocks for r in decode_block(b, tags)] == rows
    (tmp_path / "t.bin").write_bytes(b"".join(blocks))
    assert sorted(tuple(r) for r in read_blocks(spark, str(tmp_path / "t.bin"), schema, 256).collect()) == rows
    with pytest.raises(ValueError):
        list(encode_blocks([(1, 1, 0.0, 0.0, "x" * 300)], tags, 256))
    some = read_blocks(spark, str(tmp_path / "t.bin"), schema, 256, ["s", "n"])
    assert some.columns == ["s", "n"] and sorted(map(tuple, some.collect()), key=lambda r: r[1]) == [(r[4], r[1]) for r in rows]
    numbers = [r[:4] for r in rows]
    for wanted in ([0], [1, 3], [0, 1, 2, 3]):
        got = [r for b in encode_blocks(numbers, tags[:4], 256) for r in decode_block(b, tags[:4], wanted)]
        assert got == [tuple(r[n] for n in wanted) for r in numbers]
    with pytest.raises(ValueError, match="unknown columns"):
        read_blocks(spark, str(tmp_path / "t.bin"), schema, 256, ["q"])
    (tmp_path / "bad.bin").write_bytes(b"x" * 300)
    with pytest.raises(ValueError, match="whole blocks"):
        read_blocks(spark, str(tmp_path / "bad.bin"), schema, 256)
    (tmp_path / "empty.bin").write_bytes(b"")
    assert read_blocks(spark, str(tmp_path / "empty.bin"), schema, 256).count() == 0


def test_discovery(spark, tmp_path):
    base = folder(tmp_path, "1|2|0.5|1|a\n")
    (tmp_path / "lost.csv").write_text("1\n")
    (tmp_path / "other.txt").write_text("1\n")
    with pytest.warns(UserWarning, match="lost.csv"):
        assert discover(spark, base) == ["t"]
    with pytest.warns(UserWarning, match="lost.csv"):
        assert catalog_of_folder(spark, base).names() == ["t"]


def test_physical_order(spark, tmp_path):
    down = F.when(F.col("id") == 700, -1).otherwise(F.col("id"))
    holes = F.when(F.col("id") % 3 > 0, F.col("id"))
    df = spark.range(0, 1000, 1, 3).select("id", (-F.col("id")).alias("minus"), down.alias("d"), holes.alias("h"), F.lit("x").alias("s"), F.lit(None).cast("int").alias("none"))
    df.write.parquet(str(tmp_path / "t"))
    for stretch in (7, 10**6):
        assert physically_ordered(spark.read.parquet(str(tmp_path / "t")), stretch) == ["id", "h", "s", "none"]


@pytest.mark.parametrize(("x", "text"), [(1.0, "1.0"), (0.1, "0.1"), (1e10, "10000000000.0"), (1e-5, "0.00001"), (-0.0, "-0.0"), (float("nan"), "NaN.0"), (float("inf"), "inf.0"), (1e22, "10000000000000000000000.0")])
def test_float_text(x, text):
    assert format_float(x) == text


def test_single_float_text():
    assert format_float(0.1, single=True) == "0.1"


def test_runner(spark):
    catalog = Catalog().register("t", spark.createDataFrame([(2, "b", 1.5), (1, "a", 2.0)], "i int, s string, d double"))
    plan = Scan("t").sort("i").project("s", "d").build()
    assert list(protocol_lines(spark.createDataFrame([(1, None)], "i int, s string"))) == ["validate", "1||", "!"]
    assert list(protocol_lines(spark.createDataFrame([(1, None), (2, float("nan"))], "i int, d double").coalesce(1)))[1:3] == ["1||", "2|NaN.0|"]
    good = Case("ok", plan.to_json(), ("a|2.0|", "b|1.5|"))
    assert run_suite(catalog, [good, Case("off", "", (), disabled=True), Case("any", plan.to_json(), ("b|1.5|", "a|2.0|"), True)]) == ["ok", "any"]
    for wrong in (("b|1.5|", "a|2.0|"), ("a|2.0|",)):
        with pytest.raises(Mismatch):
            run_suite(catalog, [Case("bad", plan.to_json(), wrong)])


def test_statistics(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("int").alias("k"), F.concat(F.lit("s"), F.col("id") % 3).alias("s"))
    stats = column_statistics(df)
    assert stats["k"] == {"cardinality": 7, "density": 0.007, "lower_bound": 0, "upper_bound": 6}
    assert stats["s"] == {"cardinality": 3, "density": 0.003}
    assert abs(column_statistics(df, exact_limit=10)["id"]["cardinality"] - 1000) < 60
    assert column_statistics(df.filter("id < 0")) == {}
    rows = equi_depth_histogram(df, "id").orderBy("bucket").collect()
    assert [(r.lower_bound, r.upper_bound, r.frequency) for r in rows] == [(n * 100, n * 100 + 99, 100) for n in range(10)]
    assert is_ordered(df, "id", "id", 64).first()[0] and not is_ordered(df, "k", "id", 64).first()[0]
    assert uniform_sample(df, 10).count() == 10
    entry = json.loads(dump_catalog([table_entry("t", df)]))
    points = entry["table_specs"][0]["column_specs"][0]["stats"][-1]["HistogramStat"]["frequency_points"]
    assert points[1] == [{"lower_bound": {"Int64": 100}, "upper_bound": {"Int64": 199}}, 100] and len(points) == 10
    assert "HistogramStat" in entry["table_specs"][0]["column_specs"][2]["stats"][-1]
    many = df.select(F.col("id").cast("string").alias("s"))
    assert [list(s)[0] for s in table_entry("t", many, ordered=["q"])["column_specs"][0]["stats"]] == ["CardinalityStat", "DensityStat"]
    assert table_entry("t", df, ordered=["id"])["column_specs"][0]["stats"][0] == "IsPhysicallyOrdered"
    assert entry["table_specs"][0]["column_specs"][1]["stats"][0] == {"RangeStat": {"lower_bound": {"Int32": 0}, "upper_bound": {"Int32": 6}}}
    assert load_schemas(json.dumps(entry))["t"].names == ["id", "k", "s"]


def test_io_model(spark):
    disk = Geometry()
    trace = [(1, "get", 1, 4), (2, "get", 5, 1), (3, "get", 4096 * 100, 2), (4, "put", 4096 * 101, 1), (5, "get", 9, 0)]
    df = spark.createDataFrame(trace, "seq long, kind string, start_block long, num_blocks long")
    got = {r.seq: (r.seek_ms, r.rotation_ms) for r in request_costs(df).collect()}
    turn = round(0.5 * 60000 / 7200, 6)
    far = round(0.8 + 17.2 * (100 / 500_000) ** 0.5, 6)
    assert got == {1: (0.0, 0.0), 2: (0.0, 0.0), 3: (far, turn), 4: (0.8, turn)}
    report = io_report(df).first()
    assert (report.reads, report.writes, report.blocks, report.cylinders) == (4, 1, 8, 101)
    assert report.transfer_us == pytest.approx(8 * disk.block_size / 150, abs=0.01)
