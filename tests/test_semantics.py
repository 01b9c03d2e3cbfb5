import math

import pytest
from pyspark.sql import types as T

from sparrel import Catalog, Query, Scan, col, compile_plan, f32, f64, i32, i64, string
from sparrel.plans.algebra import Filter, Project, Sort
from sparrel.streaming import require_streamable

NAN = float("nan")
SCHEMA = T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()), T.StructField("f", T.FloatType()),
    T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()),
])


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(1, 1, 1.0, 1.0, "a"), (2, 3, 2.5, 2.0, "é"), (3, 2, NAN, NAN, ""), (4, 4, 0.0, -0.0, "Z")]
    c = Catalog()
    c.register("typed", spark.createDataFrame(rows, SCHEMA))
    c.register("empty", spark.createDataFrame([], SCHEMA))
    c.register("dotted", spark.createDataFrame([(1, 10), (2, 20)], "`t.a` int, `t.b` int"))
    c.register("other", spark.createDataFrame([(7, "x"), (8, "y")], "i int, s string"))
    return c


def ids(catalog, *tests):
    return sorted(r[0] for r in compile_plan(Scan("typed").filter(*tests).project("i").build(), catalog).collect())


@pytest.mark.parametrize(("op", "kept"), [("EQ", []), ("LT", []), ("LTE", []), ("GT", []), ("GTE", []), ("NE", [1, 2, 3, 4])])
@pytest.mark.parametrize("value", [i64(1), f32(1), f64(1), string("1")])
def test_other_tags_never_match(catalog, op, kept, value):
    assert ids(catalog, ("i", op, value)) == kept
    if op == "EQ":
        assert ids(catalog, ("i", "EQ", col("l"))) == []


@pytest.mark.parametrize("c,lit", [("f", f32), ("d", f64)])
def test_nan_equals_nothing_and_has_no_order(catalog, c, lit):
    assert ids(catalog, (c, "EQ", lit(NAN))) == []
    assert ids(catalog, (c, "NE", lit(NAN))) == [1, 2, 3, 4]
    assert ids(catalog, (c, "GT", lit(0.5))) == [1, 2]
    assert ids(catalog, (c, "GTE", lit(-math.inf))) == [1, 2, 4]
    assert ids(catalog, (c, "NE", lit(1.0))) == [2, 3, 4]
    assert ids(catalog, (c, "EQ", col(c))) == [1, 2, 4]
    assert ids(catalog, (c, "NE", col(c))) == [3]
    assert ids(catalog, (c, "LTE", col(c))) == [1, 2, 4]
    assert ids(catalog, (c, "EQ", lit(0.0))) == [4]


def test_strings_compare_as_bytes(catalog):
    rows = compile_plan(Scan("typed").sort("s").project("s").build(), catalog).collect()
    assert [r[0] for r in rows] == ["", "Z", "a", "é"]


def test_nan_join_stays_an_equi_join(catalog):
    plan = Scan("typed").project(("d", "d1")).cross(Scan("typed").project(("d", "d2"))).filter(("d1", "EQ", col("d2"))).build()
    df = compile_plan(plan, catalog)
    assert len(df.collect()) == 3
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_last_column_of_a_name_wins(catalog):
    df = compile_plan(Scan("typed").cross(Scan("other")).filter(("i", "EQ", i32(7))).project("i", "s").build(), catalog)
    assert [tuple(r) for r in df.collect()] == [(7, "x")] * 4
    both = compile_plan(Scan("typed").cross(Scan("other")).build(), catalog)
    assert both.columns == ["i", "l", "f", "d", "s", "i", "s"]


def test_dots_and_repeats(catalog):
    df = compile_plan(Scan("dotted").filter(("t.a", "GT", i32(1))).project("t.b", ("t.b", "again")).build(), catalog)
    assert df.columns == ["t.b", "again"]
    assert [tuple(r) for r in df.collect()] == [(20, 20)]


@pytest.mark.parametrize("plan", [
    Scan("typed").filter(("nope", "EQ", i32(1))), Scan("typed").project("nope"), Scan("typed").sort("nope"),
    Scan("typed").filter(("i", "EQ", col("nope"))), Scan("typed").project("i").filter(("s", "EQ", string("a"))),
    Scan("typed").cross(Scan("other")).filter(("nope", "EQ", i32(1))), Scan("typed").filter(("I", "EQ", i32(1))), Scan("nowhere"),
])
def test_unknown_names_raise(catalog, plan):
    with pytest.raises(ValueError, match="unknown"):
        compile_plan(plan.build(), catalog)


def test_empty_lists(catalog):
    assert compile_plan(Query(Filter((), Scan("typed"))), catalog).count() == 4
    assert compile_plan(Query(Sort((), Scan("typed"))), catalog).count() == 4
    assert compile_plan(Query(Project((), Scan("typed"))), catalog).columns == []
    for build in (lambda: Scan("a").filter(), lambda: Scan("a").sort(), lambda: Scan("a").project()):
        with pytest.raises(ValueError):
            build()


def test_empty_tables(catalog):
    empty = Scan("empty")
    for plan in (empty.sort("i"), empty.cross(Scan("other")), empty.filter(("i", "GT", i32(0))), empty.project("i")):
        assert compile_plan(plan.build(), catalog).count() == 0


def test_filter_over_filtered_cross_keeps_all_columns(catalog):
    plan = Scan("typed").cross(Scan("dotted")).filter(("i", "EQ", col("t.a"))).filter(("t.b", "GTE", i32(0))).sort("i").project(("i", "id")).build()
    assert [r.id for r in compile_plan(plan, catalog).collect()] == [1, 2]


def test_bad_plans_raise():
    with pytest.raises(ValueError):
        Query.from_json('{"root":{"Limit":{}}}')
    with pytest.raises(ValueError):
        Query.from_json('{"root":{"Filter":{"predicates":[{"column_name":"a","operator":"LIKE","value":{"I32":1}}],"underlying":{"Scan":{"table_id":"t"}}}}}')


def test_streaming_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as int) i").write.parquet(str(tmp_path / "in"))
    catalog = Catalog().register("s", spark.readStream.schema("i int").parquet(str(tmp_path / "in")))
    query = Scan("s").filter(("i", "GT", i32(6))).project(("i", "j")).build()
    require_streamable(query)
    run = compile_plan(query, catalog).writeStream.format("memory").queryName("out_s").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.j for r in spark.table("out_s").collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        require_streamable(Scan("s").sort("i").build())
