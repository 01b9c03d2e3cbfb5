import sqlite3

import pytest

from sparrel import Query, Scan, compile_plan
from sparrel.ingest import ingest, main
from sparrel.plans.demo import sample
from sparrel.runner import Case, load_suite, run_suite, save_suite
from sparrel.sources.blocks import read_blocks
from sparrel.sources.delimited import parse_schema
from sparrel.sources.metadata import load_schemas


def test_ingest_and_suite(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    target.mkdir()
    schema = "k|v|s|\nI32|FLOAT64|STRING|\n"
    (source / "t.schema").write_text(schema)
    (source / "t.csv").write_text("1|0.5|it's \"x\"|\n2|2|é|\n")
    catalog = ingest(spark, str(source), str(target), sqlite=True, blocks=True)
    rows = [(1, 0.5, "it's \"x\""), (2, 2.0, "é")]
    assert sorted(map(tuple, catalog.table("t").collect())) == rows
    assert sorted(sqlite3.connect(target / "tables.db").execute("SELECT * FROM t").fetchall()) == rows
    assert sorted(map(tuple, read_blocks(spark, str(target / "t.bin"), parse_schema(schema)).collect())) == rows
    assert load_schemas((target / "catalog.json").read_text())["t"].names == ["k", "v", "s"]
    assert "IsPhysicallyOrdered" in (target / "catalog.json").read_text()
    case = Case("one", Scan("t").sort("k").project("s", "v").build().to_json(), ("it's \"x\"|0.5|", "é|2.0|"))
    save_suite(str(tmp_path / "suite.json"), [case, Case("off", case.plan, (), True, True)])
    assert load_suite(str(tmp_path / "suite.json"))[0] == case
    assert run_suite(catalog, load_suite(str(tmp_path / "suite.json"))) == ["one"]
    with pytest.raises(SystemExit):
        main(["only"])


def test_sample_plan(spark):
    query = Query.from_json(sample().to_json())
    from sparrel import Catalog

    catalog = Catalog().register("A", spark.createDataFrame([(1, 5), (2, 6)], "a1 int, a2 int")).register("B", spark.createDataFrame([(1, 9, 3), (2, 6, 4)], "b1 int, b2 int, b3 int"))
    assert [tuple(r) for r in compile_plan(query, catalog).collect()] == [(1, 3)]
