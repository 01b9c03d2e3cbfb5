"""The query suite: sixty plans over the TPC-H-like tables and the SQL each must agree with.

``PS`` is a stand-in for a part-supplier table, projected from lineitem. Fixed values: the shapes of
the queries and their constants follow a published workload, adapted to these tables.
"""

from __future__ import annotations

from sparrel.plans.algebra import Node, Query, Scan, col, f64, i32, i64, string, timestamp

PS = Scan("lineitem").project(
    ("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey"),
    ("l_quantity", "ps_availqty"), ("l_extendedprice", "ps_supplycost"),
)
PS_SQL = (
    "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, l_quantity AS ps_availqty, "
    "l_extendedprice AS ps_supplycost FROM lineitem)"
)

region, nation, supplier, customer = Scan("region"), Scan("nation"), Scan("supplier"), Scan("customer")
part, orders, lineitem = Scan("part"), Scan("orders"), Scan("lineitem")


def joined(first: Node, *others: Node) -> Node:
    """Left-deep cross product; the filter above it names the join keys."""
    for other in others:
        first = first.cross(other)
    return first


def down(name: str) -> tuple[str, bool]:
    return name, False


def eq(a: str, b: str) -> tuple:
    return a, "EQ", col(b)


def aliased(node: Node, prefix: str, *columns: str) -> Node:
    return node.project(*[(c, f"{prefix}.{c}") for c in columns])


def _queries() -> dict[str, tuple[Query, str]]:
    q: dict[str, tuple[Node, str]] = {}
    # scans and projections
    q["q01"] = nation.project("n_nationkey", "n_name", "n_regionkey"), "SELECT n_nationkey, n_name, n_regionkey FROM nation"
    q["q02"] = region.project("r_regionkey", "r_name"), "SELECT r_regionkey, r_name FROM region"
    q["q03"] = part.project("p_partkey", "p_name", "p_brand", "p_type"), "SELECT p_partkey, p_name, p_brand, p_type FROM part"
    q["q04"] = supplier.project("s_suppkey", "s_name", "s_acctbal"), "SELECT s_suppkey, s_name, s_acctbal FROM supplier"
    q["q05"] = customer.project("c_custkey", "c_name", "c_mktsegment"), "SELECT c_custkey, c_name, c_mktsegment FROM customer"
    # filters
    q["q06"] = nation.filter(("n_regionkey", "EQ", i32(1))).project("n_name"), "SELECT n_name FROM nation WHERE n_regionkey = 1"
    q["q07"] = region.filter(("r_name", "NE", string("AFRICA"))).project("r_name"), "SELECT r_name FROM region WHERE r_name <> 'AFRICA'"
    q["q08"] = part.filter(("p_size", "GT", i32(25))).project("p_name", "p_size"), "SELECT p_name, p_size FROM part WHERE p_size > 25"
    q["q09"] = part.filter(("p_retailprice", "GTE", f64(950))).project("p_partkey", "p_retailprice"), "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 950.0"
    q["q10"] = supplier.filter(("s_acctbal", "LT", f64(0))).project("s_name", "s_acctbal"), "SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal < 0.0"
    q["q11"] = customer.filter(("c_mktsegment", "EQ", string("AUTOMOBILE"))).project("c_name", "c_mktsegment"), "SELECT c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'AUTOMOBILE'"
    q["q12"] = orders.filter(("o_orderstatus", "EQ", string("O"))).project("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'"
    q["q13"] = lineitem.filter(("l_quantity", "LTE", f64(10))).project("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10"
    q["q14"] = PS.filter(("ps_availqty", "GT", f64(45))).project("ps_partkey", "ps_suppkey"), f"SELECT ps_partkey, ps_suppkey FROM {PS_SQL} ps WHERE ps_availqty > 45"
    q["q15"] = (
        lineitem.filter(("l_discount", "GTE", f64(0.05)), ("l_discount", "LTE", f64(0.07))).project("l_orderkey", "l_discount"),
        "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount >= 0.05::DOUBLE AND l_discount <= 0.07::DOUBLE",
    )
    # sorts
    q["q16"] = nation.sort("n_name", "n_nationkey").project("n_name"), "SELECT n_name FROM nation ORDER BY n_name, n_nationkey"
    q["q17"] = region.sort(down("r_name"), "r_regionkey").project("r_name"), "SELECT r_name FROM region ORDER BY r_name DESC, r_regionkey"
    q["q18"] = part.sort("p_brand", down("p_size"), "p_partkey").project("p_brand", "p_size"), "SELECT p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey"
    q["q19"] = supplier.sort(down("s_acctbal"), "s_suppkey").project("s_acctbal", "s_name"), "SELECT s_acctbal, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey"
    q["q20"] = customer.sort("c_mktsegment", down("c_acctbal"), "c_custkey").project("c_mktsegment", "c_acctbal"), "SELECT c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey"
    # filters and sorts
    q["q21"] = nation.filter(("n_regionkey", "EQ", i32(3))).sort(down("n_name"), "n_nationkey").project("n_name"), "SELECT n_name FROM nation WHERE n_regionkey = 3 ORDER BY n_name DESC, n_nationkey"
    q["q22"] = part.filter(("p_size", "LT", i32(10))).sort("p_name", "p_partkey").project("p_name"), "SELECT p_name FROM part WHERE p_size < 10 ORDER BY p_name, p_partkey"
    q["q23"] = supplier.filter(("s_acctbal", "GT", f64(5000))).sort(down("s_acctbal"), "s_suppkey").project("s_name", "s_acctbal"), "SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000.0 ORDER BY s_acctbal DESC, s_suppkey"
    q["q24"] = customer.filter(("c_mktsegment", "EQ", string("HOUSEHOLD"))).sort("c_name", "c_custkey").project("c_name"), "SELECT c_name FROM customer WHERE c_mktsegment = 'HOUSEHOLD' ORDER BY c_name, c_custkey"
    q["q25"] = orders.filter(("o_orderstatus", "EQ", string("F"))).sort(down("o_totalprice"), "o_orderkey").project("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey"
    q["q26"] = (
        lineitem.filter(("l_shipdate", "GT", timestamp("1998-01-01"))).sort(down("l_quantity"), "l_orderkey", "l_linenumber").project("l_orderkey", "l_quantity"),
        "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01' ORDER BY l_quantity DESC, l_orderkey, l_linenumber",
    )
    q["q27"] = PS.filter(("ps_availqty", "LT", f64(5))).sort("ps_suppkey", "ps_partkey").project("ps_suppkey"), f"SELECT ps_suppkey FROM {PS_SQL} ps WHERE ps_availqty < 5 ORDER BY ps_suppkey, ps_partkey"
    q["q28"] = (
        lineitem.filter(("l_returnflag", "EQ", string("R")), ("l_linestatus", "EQ", string("F"))).sort(down("l_extendedprice"), "l_orderkey", "l_linenumber").project("l_extendedprice"),
        "SELECT l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber",
    )
    q["q29"] = customer.filter(("c_acctbal", "LT", f64(0))).sort("c_name", "c_custkey").project("c_name"), "SELECT c_name FROM customer WHERE c_acctbal < 0.0 ORDER BY c_name, c_custkey"
    q["q30"] = part.filter(("p_type", "EQ", string("PROMO"))).sort("p_brand", "p_partkey").project("p_brand"), "SELECT p_brand FROM part WHERE p_type = 'PROMO' ORDER BY p_brand, p_partkey"
    # cross products, with filtered inputs as derived tables
    q["q31"] = nation.cross(region).project("n_name", "r_name"), "SELECT n_name, r_name FROM nation, region"
    q["q32"] = supplier.cross(region).project("s_name", "r_name"), "SELECT s_name, r_name FROM supplier, region"
    q["q33"] = customer.filter(("c_custkey", "EQ", i64(1))).cross(nation).project("c_name", "n_name"), "SELECT c_name, n_name FROM (SELECT * FROM customer WHERE c_custkey = 1) c, nation"
    q["q34"] = (
        part.filter(("p_partkey", "EQ", i64(10))).cross(PS.filter(("ps_suppkey", "EQ", i64(5)))).project("p_name", "ps_availqty"),
        f"SELECT p_name, ps_availqty FROM (SELECT * FROM part WHERE p_partkey = 10) p, (SELECT * FROM {PS_SQL} ps WHERE ps_suppkey = 5) ps2",
    )
    q["q35"] = (
        orders.filter(("o_orderkey", "EQ", i64(5))).cross(lineitem.filter(("l_orderkey", "EQ", i64(5)))).project("o_orderkey", "l_linenumber"),
        "SELECT o_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_orderkey = 5) o, (SELECT * FROM lineitem WHERE l_orderkey = 5) l",
    )
    # two-way joins
    q["q36"] = nation.cross(region).filter(eq("n_regionkey", "r_regionkey")).project("n_name", "r_name"), "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"
    q["q37"] = customer.cross(nation).filter(eq("c_nationkey", "n_nationkey")).project("c_name", "n_name"), "SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey"
    q["q38"] = supplier.cross(nation).filter(eq("s_nationkey", "n_nationkey")).project("s_name", "n_name"), "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey"
    q["q39"] = part.cross(PS).filter(eq("p_partkey", "ps_partkey")).project("p_name", "ps_availqty"), f"SELECT p_name, ps_availqty FROM part, {PS_SQL} ps WHERE p_partkey = ps_partkey"
    q["q40"] = supplier.cross(PS).filter(eq("s_suppkey", "ps_suppkey")).project("s_name", "ps_availqty"), f"SELECT s_name, ps_availqty FROM supplier, {PS_SQL} ps WHERE s_suppkey = ps_suppkey"
    # joins with filters and sorts
    q["q41"] = (
        customer.cross(orders).filter(eq("c_custkey", "o_custkey"), ("c_mktsegment", "EQ", string("MACHINERY"))).sort(down("o_totalprice"), "c_custkey", "o_orderkey").project("c_name", "o_totalprice"),
        "SELECT c_name, o_totalprice FROM customer, orders WHERE c_custkey = o_custkey AND c_mktsegment = 'MACHINERY' ORDER BY o_totalprice DESC, c_custkey, o_orderkey",
    )
    q["q42"] = (
        orders.cross(lineitem).filter(eq("o_orderkey", "l_orderkey"), ("o_orderstatus", "EQ", string("P"))).sort("o_orderdate", "l_orderkey", "l_linenumber").project("o_orderdate", "l_quantity"),
        "SELECT o_orderdate, l_quantity FROM orders, lineitem WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P' ORDER BY o_orderdate, l_orderkey, l_linenumber",
    )
    q["q43"] = (
        nation.cross(region).filter(eq("n_regionkey", "r_regionkey"), ("r_name", "EQ", string("EUROPE"))).sort("n_name", "n_nationkey").project("n_name", "r_name"),
        "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'EUROPE' ORDER BY n_name, n_nationkey",
    )
    q["q44"] = (
        supplier.cross(nation).filter(eq("s_nationkey", "n_nationkey"), ("s_acctbal", "GT", f64(1000))).sort(down("s_acctbal"), "s_suppkey").project("s_name", "n_name"),
        "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 1000.0 ORDER BY s_acctbal DESC, s_suppkey",
    )
    q["q45"] = (
        part.cross(PS).filter(eq("p_partkey", "ps_partkey"), ("p_size", "EQ", i32(50))).sort(down("ps_supplycost"), "p_partkey", "ps_suppkey").project("p_name", "ps_supplycost"),
        f"SELECT p_name, ps_supplycost FROM part, {PS_SQL} ps WHERE p_partkey = ps_partkey AND p_size = 50 ORDER BY ps_supplycost DESC, p_partkey, ps_suppkey",
    )
    q["q46"] = (
        joined(customer, nation, region).filter(eq("c_nationkey", "n_nationkey"), eq("n_regionkey", "r_regionkey"), ("r_name", "EQ", string("ASIA"))).sort("c_name", "c_custkey").project("c_name", "n_name"),
        "SELECT c_name, n_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' ORDER BY c_name, c_custkey",
    )
    q["q47"] = (
        joined(part, supplier, PS).filter(eq("p_partkey", "ps_partkey"), eq("s_suppkey", "ps_suppkey"), ("p_size", "LT", i32(5))).sort("p_brand", "s_name", "p_partkey", "s_suppkey").project("p_brand", "s_name"),
        f"SELECT p_brand, s_name FROM part, supplier, {PS_SQL} ps WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 5 ORDER BY p_brand, s_name, p_partkey, s_suppkey",
    )
    q["q48"] = (
        orders.cross(customer).filter(eq("o_custkey", "c_custkey"), ("o_totalprice", "GT", f64(50000))).sort(down("o_totalprice"), "o_orderkey").project("o_orderkey", "c_mktsegment"),
        "SELECT o_orderkey, c_mktsegment FROM orders, customer WHERE o_custkey = c_custkey AND o_totalprice > 50000.0 ORDER BY o_totalprice DESC, o_orderkey",
    )
    q["q49"] = (
        lineitem.cross(part).filter(eq("l_partkey", "p_partkey"), ("l_quantity", "GT", f64(45))).sort("p_name", "l_orderkey", "l_linenumber").project("l_linenumber", "p_name"),
        "SELECT l_linenumber, p_name FROM lineitem, part WHERE l_partkey = p_partkey AND l_quantity > 45 ORDER BY p_name, l_orderkey, l_linenumber",
    )
    q["q50"] = (
        joined(supplier, part, PS).filter(eq("s_suppkey", "ps_suppkey"), eq("p_partkey", "ps_partkey"), ("ps_availqty", "EQ", f64(1))).sort("s_name", "p_name", "s_suppkey", "p_partkey").project("s_name", "p_name"),
        f"SELECT s_name, p_name FROM supplier, part, {PS_SQL} ps WHERE s_suppkey = ps_suppkey AND p_partkey = ps_partkey AND ps_availqty = 1 ORDER BY s_name, p_name, s_suppkey, p_partkey",
    )
    # benchmark plans
    q["b01"] = (
        lineitem.filter(("l_shipdate", "LTE", timestamp("1998-11-30"))).sort("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
        .project("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
        "SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-11-30' ORDER BY l_returnflag, l_linestatus, l_orderkey, l_linenumber",
    )
    q["b02"] = (
        joined(part, supplier, PS, nation, region)
        .filter(eq("p_partkey", "ps_partkey"), eq("s_suppkey", "ps_suppkey"), ("p_size", "EQ", i32(15)), eq("s_nationkey", "n_nationkey"), eq("n_regionkey", "r_regionkey"), ("r_name", "EQ", string("EUROPE")))
        .sort(down("s_acctbal"), "n_name", "s_name", "p_partkey", "ps_suppkey").project("s_acctbal", "s_name", "n_name", "p_partkey", "p_brand", "ps_supplycost"),
        f"SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, ps_supplycost FROM part, supplier, {PS_SQL} ps, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE' ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, ps_suppkey",
    )
    q["b03"] = (
        joined(customer, orders, lineitem)
        .filter(("c_mktsegment", "EQ", string("BUILDING")), eq("c_custkey", "o_custkey"), eq("l_orderkey", "o_orderkey"), ("o_orderdate", "LT", timestamp("1998-03-15")), ("l_shipdate", "GT", timestamp("1998-03-15")))
        .sort("o_orderdate", "l_orderkey", "l_linenumber").project("l_orderkey", "o_orderdate", "o_orderpriority"),
        "SELECT l_orderkey, o_orderdate, o_orderpriority FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' ORDER BY o_orderdate, l_orderkey, l_linenumber",
    )
    q["b04"] = (
        joined(customer, orders, lineitem, supplier, nation, region)
        .filter(eq("c_custkey", "o_custkey"), eq("l_orderkey", "o_orderkey"), eq("l_suppkey", "s_suppkey"), eq("c_nationkey", "s_nationkey"), eq("s_nationkey", "n_nationkey"), eq("n_regionkey", "r_regionkey"),
                ("r_name", "EQ", string("ASIA")), ("o_orderdate", "GTE", timestamp("1996-01-01")), ("o_orderdate", "LT", timestamp("1997-01-01")))
        .sort(down("l_extendedprice"), down("l_discount"), "l_orderkey", "l_linenumber").project("n_name", "l_extendedprice", "l_discount"),
        "SELECT n_name, l_extendedprice, l_discount FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' ORDER BY l_extendedprice DESC, l_discount DESC, l_orderkey, l_linenumber",
    )
    q["b05"] = (
        lineitem.filter(("l_shipdate", "GTE", timestamp("1996-01-01")), ("l_shipdate", "LT", timestamp("1997-01-01")), ("l_discount", "GT", f64(0.05)), ("l_discount", "LT", f64(0.07)), ("l_quantity", "LT", f64(24)))
        .sort("l_orderkey", "l_linenumber").project("l_extendedprice", "l_discount"),
        "SELECT l_extendedprice, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount > 0.05::DOUBLE AND l_discount < 0.07::DOUBLE AND l_quantity < 24 ORDER BY l_orderkey, l_linenumber",
    )
    q["b06"] = (
        joined(customer, orders, lineitem, nation)
        .filter(eq("c_custkey", "o_custkey"), eq("l_orderkey", "o_orderkey"), ("o_orderdate", "GTE", timestamp("1996-10-01")), ("o_orderdate", "LT", timestamp("1997-10-01")), ("l_returnflag", "EQ", string("R")), eq("c_nationkey", "n_nationkey"))
        .sort(down("l_extendedprice"), down("l_discount"), "l_orderkey", "l_linenumber").project("c_custkey", "c_name", "l_extendedprice", "l_discount", "c_acctbal", "n_name", "c_mktsegment"),
        "SELECT c_custkey, c_name, l_extendedprice, l_discount, c_acctbal, n_name, c_mktsegment FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-10-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey ORDER BY l_extendedprice DESC, l_discount DESC, l_orderkey, l_linenumber",
    )
    q["b07"] = (
        joined(PS, supplier, nation).filter(eq("ps_suppkey", "s_suppkey"), eq("s_nationkey", "n_nationkey"), ("n_name", "EQ", string("NATION_7")))
        .sort(down("ps_availqty"), "ps_partkey", "ps_suppkey").project("ps_partkey", "ps_supplycost", "ps_availqty"),
        f"SELECT ps_partkey, ps_supplycost, ps_availqty FROM {PS_SQL} ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' ORDER BY ps_availqty DESC, ps_partkey, ps_suppkey",
    )
    q["b08"] = (
        joined(supplier, nation, PS, part, lineitem)
        .filter(eq("s_nationkey", "n_nationkey"), ("n_name", "EQ", string("NATION_3")), eq("s_suppkey", "ps_suppkey"), eq("ps_partkey", "p_partkey"), eq("l_partkey", "ps_partkey"), eq("l_suppkey", "ps_suppkey"))
        .sort("s_name", "l_orderkey", "l_linenumber").project("s_name", "s_suppkey", "ps_partkey", "ps_availqty", "l_quantity"),
        f"SELECT s_name, s_suppkey, ps_partkey, ps_availqty, l_quantity FROM supplier, nation, {PS_SQL} ps, part, lineitem WHERE s_nationkey = n_nationkey AND n_name = 'NATION_3' AND s_suppkey = ps_suppkey AND ps_partkey = p_partkey AND l_partkey = ps_partkey AND l_suppkey = ps_suppkey ORDER BY s_name, l_orderkey, l_linenumber",
    )
    keys = ("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    q["b09"] = (
        joined(supplier, aliased(lineitem, "l1", *keys), aliased(lineitem, "l2", *keys), orders, nation)
        .filter(eq("s_suppkey", "l1.l_suppkey"), eq("o_orderkey", "l1.l_orderkey"), ("o_orderstatus", "EQ", string("F")), ("l1.l_partkey", "GT", col("l1.l_suppkey")),
                eq("l2.l_orderkey", "l1.l_orderkey"), ("l2.l_suppkey", "NE", col("l1.l_suppkey")), eq("s_nationkey", "n_nationkey"), ("n_name", "EQ", string("NATION_20")))
        .sort("s_name", "l1.l_orderkey", "l1.l_linenumber", "l2.l_orderkey", "l2.l_linenumber").project("s_name", ("l1.l_orderkey", "l1_l_orderkey"), ("l1.l_suppkey", "l1_l_suppkey")),
        "SELECT s_name, l1.l_orderkey AS l1_l_orderkey, l1.l_suppkey AS l1_l_suppkey FROM supplier, lineitem l1, lineitem l2, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_partkey > l1.l_suppkey AND l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_20' ORDER BY s_name, l1.l_orderkey, l1.l_linenumber, l2.l_orderkey, l2.l_linenumber",
    )
    places = [aliased(nation, a, "n_nationkey", "n_name", "n_regionkey") for a in ("cn", "sn")] + [aliased(region, a, "r_regionkey", "r_name") for a in ("cr", "sr")]
    q["b10"] = (
        joined(customer, orders, lineitem, part, supplier, *places)
        .filter(eq("c_custkey", "o_custkey"), eq("o_orderkey", "l_orderkey"), eq("l_partkey", "p_partkey"), eq("l_suppkey", "s_suppkey"), eq("c_nationkey", "cn.n_nationkey"), eq("s_nationkey", "sn.n_nationkey"),
                eq("cn.n_regionkey", "cr.r_regionkey"), eq("sn.n_regionkey", "sr.r_regionkey"), ("c_mktsegment", "EQ", string("BUILDING")), ("l_returnflag", "EQ", string("R")),
                ("p_size", "GTE", i32(1)), ("p_size", "LTE", i32(25)), ("cr.r_name", "EQ", string("ASIA")), ("sr.r_name", "EQ", string("EUROPE")))
        .sort("c_custkey", "o_orderdate", "o_orderkey", "l_linenumber")
        .project("c_custkey", "c_name", "o_orderkey", "o_orderdate", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name", ("cn.n_name", "cn_n_name"), ("sn.n_name", "sn_n_name")),
        "SELECT c_custkey, c_name, o_orderkey, o_orderdate, l_linenumber, l_partkey, l_suppkey, p_name, s_name, cn.n_name AS cn_n_name, sn.n_name AS sn_n_name FROM customer, orders, lineitem, part, supplier, nation cn, nation sn, region cr, region sr WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND cn.n_regionkey = cr.r_regionkey AND sn.n_regionkey = sr.r_regionkey AND c_mktsegment = 'BUILDING' AND l_returnflag = 'R' AND p_size >= 1 AND p_size <= 25 AND cr.r_name = 'ASIA' AND sr.r_name = 'EUROPE' ORDER BY c_custkey, o_orderdate, o_orderkey, l_linenumber",
    )
    # shapes beyond the sixty
    q["x_theta_cross"] = nation.cross(region).filter(("n_regionkey", "LT", col("r_regionkey"))).project("n_name", "r_name"), "SELECT n_name, r_name FROM nation, region WHERE n_regionkey < r_regionkey"
    q["x_ne_join"] = nation.cross(region).filter(("n_regionkey", "NE", col("r_regionkey"))).project("n_name", "r_name"), "SELECT n_name, r_name FROM nation, region WHERE n_regionkey <> r_regionkey"
    q["x_bushy"] = (
        customer.cross(nation).cross(supplier.cross(region)).filter(eq("c_nationkey", "n_nationkey"), eq("s_nationkey", "c_nationkey"), eq("n_regionkey", "r_regionkey")).project("c_custkey", "s_suppkey", "r_name"),
        "SELECT c_custkey, s_suppkey, r_name FROM customer, nation, supplier, region WHERE c_nationkey = n_nationkey AND s_nationkey = c_nationkey AND n_regionkey = r_regionkey",
    )
    q["x_cross_tag_eq"] = part.filter(("p_size", "EQ", i64(15))).project("p_partkey"), "SELECT p_partkey FROM part WHERE false"
    q["x_cross_tag_ne"] = part.filter(("p_size", "NE", i64(15))).project("p_partkey"), "SELECT p_partkey FROM part"
    q["x_composite_key"] = (
        PS.cross(lineitem).filter(eq("ps_partkey", "l_partkey"), eq("ps_suppkey", "l_suppkey"), ("ps_availqty", "LT", col("l_quantity"))).project("ps_partkey", "l_orderkey"),
        f"SELECT ps_partkey, l_orderkey FROM {PS_SQL} ps, lineitem WHERE ps_partkey = l_partkey AND ps_suppkey = l_suppkey AND ps_availqty < l_quantity",
    )
    q["x_filtered_cross_all_columns"] = nation.cross(region).filter(eq("n_regionkey", "r_regionkey")), "SELECT * FROM nation, region WHERE n_regionkey = r_regionkey"
    return {name: (node.build(), sql) for name, (node, sql) in q.items()}


SUITE = _queries()

#: Plans whose root order is part of the result.
ORDERED = frozenset([f"q{n}" for n in [*range(16, 31), *range(41, 51)]] + [f"b{n:02}" for n in range(1, 11)])
