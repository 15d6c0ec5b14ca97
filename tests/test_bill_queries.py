"""Registered bill queries over small tables made here."""

from datetime import datetime
from decimal import Decimal

import pytest

from telespark.plans import bill_queries as Q


def tables(spark, path, lines):
    """A folder of tables with order lines of (order, part, supplier, price, discount, status), all shipped on one day."""
    rows = [(o, p, s, 1, 1.0, float(price), off, 0.0, "N", status, datetime(1995, 1, 1)) for o, p, s, price, off, status in lines]
    made = {
        "lineitem": (rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                           "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "part": ([(1, "p", "Brand#22", "ECONOMY", 1, 1.0), (2, "p", "Brand#22", "MEDIUM", 1, 1.0)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(i, "s", 0, 0.0) for i in (1, 2, 10)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(0, "CHINA", 0)], "n_nationkey int, n_name string, n_regionkey int")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture
def dear(spark, tmp_path):
    """Postpaid lines of 3 * 10^11 in one month: 3 * 10^19 units. Line numbers 9, 17, ...: none of them comes twice."""
    return tables(spark, tmp_path, [(o, 2, 10, 100_000_000_000.01, 0.0, "O") for o in (1, 2, 4)] + [(o, 1, 10, 7.01, 0.0, "O") for o in (6,)])


def test_exact_lines_of_more_units_than_a_bigint_holds(spark, dear):
    got = {(r.provider, r.line, r.period): int(r.units) for r in Q.alloc_exact_lines(spark, dear).collect()}
    seven = 701_000_000
    assert got[("alicloud", "shared", "2024-01")] == 3 * 10_000_000_000_001 * 10 ** 6 > 2 ** 63
    assert sum(v for (_, line, _), v in got.items() if line != "shared") == seven


def test_exact_balance_of_more_units_than_a_bigint_holds(spark, dear):
    got = {(r.provider, r.rule, r.period): (int(r.units), int(r.off)) for r in Q.alloc_exact_balance(spark, dear).collect()}
    assert got == {("alicloud", -1, "2024-01"): (3 * 10_000_000_000_001 * 10 ** 6, 0), ("alicloud", 1, "2024-01"): (701_000_000, 0)}
    assert Decimal(got[("alicloud", -1, "2024-01")][0]) > 2 ** 63


def test_export_has_all_lines_and_no_heap_of_them(spark, dear):
    plan = Q.bill_export(spark, dear)._jdf.queryExecution().executedPlan().toString()
    assert "Limit(" not in plan.replace("WindowGroupLimit", "") and "TakeOrderedAndProject" not in plan
    assert Q.bill_export(spark, dear).count() == 4
