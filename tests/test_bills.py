from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from telespark.operators import allocation as A
from telespark.operators import bills as B
from telespark.sources.schema import ALICLOUD_COLUMNS, VOLCENGINE_COLUMNS, BillTable, BillTables

SYNC = datetime(2026, 7, 1)


def ali(spark, rows, daily=True, keys=("billing_date", "instance_id"), mode="group", extra=""):
    """(day, product, instance, amount) with optional subscription, period, unit, sync offset."""
    full = []
    for r in rows:
        day, product, inst, amount, sub, n, unit, sync = (*r, *("PayAsYouGo", "1", "月", 0)[len(r) - 4:])
        full.append((day[:7], date.fromisoformat(day) if daily else None, product, inst, float(amount), sub, n, unit, SYNC + timedelta(seconds=sync)))
    df = spark.createDataFrame(full, "billing_cycle string, billing_date date, product_name string, instance_id string, pretax_amount double, "
                               "subscription_type string, service_period string, service_period_unit string, updated_at timestamp")
    df = df.withColumns({"payment_amount": F.col("pretax_amount"), "pretax_gross_amount": F.col("pretax_amount") * 2, "currency": F.lit("CNY")})
    df = df.withColumns({c: F.lit("") for c in ALICLOUD_COLUMNS if c not in df.columns})
    return B.BillSource("alicloud_daily" if daily else "alicloud_monthly", df, keys if daily else ("billing_cycle", *keys[1:]), mode)


def volc(spark, rows, mode="group"):
    full = [(day[:7], day if ok else "", product, str(amount), inst) for day, product, inst, amount, ok in rows]
    df = spark.createDataFrame(full, "BillPeriod string, ExpenseDate string, Product string, PayableAmount string, InstanceNo string")
    df = df.withColumns({c: F.lit("") for c in VOLCENGINE_COLUMNS if c not in df.columns})
    return B.BillSource("volcengine", df, ("ExpenseDate", "InstanceNo", "Product"), mode)


JAN = B.BillFilter("2026-01", "2026-01")


def total(df):
    return float(df.agg(F.sum("amount")).head()[0])


def test_repeated_corrected_and_parallel_lines(spark):
    rows = [("2026-01-01", "x", "i", 409.41), ("2026-01-01", "x", "i", 409.41, "PayAsYouGo", "1", "月", 86_400),      # copy
            ("2026-01-01", "x", "i", -0.005, "PayAsYouGo", "1", "月", 86_402),                                         # parallel adjustment
            ("2026-01-02", "x", "i", 5, "PayAsYouGo", "1", "月", 0), ("2026-01-02", "x", "i", 7, "PayAsYouGo", "1", "月", 7200)]  # corrected
    assert total(B.normalize_bill(ali(spark, rows), JAN)) == pytest.approx(416.405)
    assert total(B.normalize_bill(ali(spark, rows, mode="final"), JAN)) == pytest.approx(6.995)
    assert total(B.normalize_bill(ali(spark, rows, mode="off"), JAN)) == pytest.approx(830.815)


def test_null_keys_are_kept(spark):
    src = ali(spark, [("2026-01-01", "x", None, 1), ("2026-01-01", "x", None, 1, "PayAsYouGo", "1", "月", 5)])
    assert total(B.normalize_bill(src, JAN)) == 1.0


def test_text_money_and_bad_dates(spark):
    src = volc(spark, [("2026-01-01", "x", "a", "1.50", True), ("2026-01-02", "x", "b", "n/a", True), ("2026-01-03", "x", "c", "", False), ("2026-01-04", "y", "d", "2", False)])
    rows = {r.instance_id: (float(r.amount), r.day) for r in B.normalize_bill(src, JAN).collect()}
    assert rows == {"a": (1.5, "2026-01-01"), "b": (0.0, "2026-01-02"), "c": (0.0, ""), "d": (2.0, "")}


def test_two_clouds_on_one_axis(spark):
    f = B.BillFilter("2026-01", "2026-03")
    lines = B.bill_lines([volc(spark, [("2026-01-01", "x", "a", 10, True)]), ali(spark, [("2026-03-01", "x", "i", 30), ("2026-01-01", "x", "i", 5)])], f)
    s = B.cost_summary(lines, f)
    assert [tuple(r) for r in s.orderBy("period").collect()] == [("2026-01", 10.0, 5.0, 15.0), ("2026-02", 0.0, 0.0, 0.0), ("2026-03", 0.0, 30.0, 30.0)]
    assert [r.change for r in B.month_over_month(s).orderBy("period").collect()] == [None, -1.0, None]


def test_breakdown_other(spark):
    lines = B.bill_lines([ali(spark, [("2026-01-01", p, p, v) for p, v in (("a", 50), ("b", 30), ("c", 25), ("", 15))])], JAN)
    rows = B.cost_breakdown(lines, "product", 2).collect()
    assert [(r.key, r.amount, r.share) for r in rows] == [("a", 50.0, 50 / 120), ("b", 30.0, 0.25)] and rows[0].other == 40.0
    assert {r.key for r in B.cost_breakdown(lines, "product", 9).collect()} == {"a", "b", "c", B.EMPTY_KEY}


def test_sources_never_mix_grains(spark):
    t = BillTables({k: BillTable(ali(spark, []).df, ["x"]) for k in ("alicloud_monthly", "alicloud_daily")})
    assert [s.kind for s in B.pick_sources(t)] == ["alicloud_monthly"] and [s.kind for s in B.pick_sources(t, by_day=True)] == ["alicloud_daily"]
    del t.tables["alicloud_monthly"]
    assert [s.kind for s in B.pick_sources(t)] == ["alicloud_daily"] and B.pick_sources(t, ("volcengine",)) == []


def test_filter_limits():
    assert B.BillFilter.recent("2026-03").periods[0] == "2025-10" and B.BillFilter("2026-01", "2026-03").previous == ("2025-10", "2025-12")
    with pytest.raises(ValueError):
        B.BillFilter("2020-01", "2026-01")


def test_service_months(spark):
    rows = [("1", "年", 12), ("3", "Month", 3), ("365", "天", 12), ("447", "day", 15), ("29511729", "秒", 11), ("1", "hour", 1), ("x", "年", 1), ("9", "?", 1), ("5", "year", 60)]
    df = spark.createDataFrame(rows, "p string, u string, want int")
    assert df.where(B.service_months(F.col("p"), F.col("u")) != F.col("want")).count() == 0


def test_detail_sorts_usage_as_numbers(spark):
    src = ali(spark, [("2026-01-01", "x", "a", 1), ("2026-01-01", "x", "b", 2), ("2026-01-01", "x", "c", 3)])
    df = src.df.withColumn("usage", F.when(F.col("instance_id") == "a", "10").when(F.col("instance_id") == "b", "9").otherwise("-"))
    src = B.BillSource(src.kind, df, src.keys)
    assert [r.instance_id for r in B.bill_detail(src, JAN, sort="usage", raw=("usage",)).collect()] == ["a", "b", "c"]
    assert B.bill_detail(src, JAN, sort="raw:usage", raw=("usage",)).head().extra == {"usage": "9"}
    for bad in (dict(sort="nope"), dict(sort="raw:usage"), dict(raw=("nope",))):
        with pytest.raises(ValueError):
            B.bill_detail(src, JAN, **bad)
    assert "raw.region" in B.export_bills(src, JAN, raw=("region",)).columns


def test_coverage(spark):
    daily, monthly = ali(spark, [("2026-01-01", "x", "a", 94)]), ali(spark, [("2026-01-01", "x", "a", 100)], daily=False)
    assert B.coverage_check(daily, monthly, JAN).head().incomplete
    assert not B.coverage_check(ali(spark, [("2026-01-01", "x", "a", 95)]), monthly, JAN).head().incomplete


# --- allocation -------------------------------------------------------------------------------

RULES = """
lines = ["a", "b"]
%s
[[rules]]
product = ["ecs"]
split = { a = 3, b = 1 }
[[rules]]
name = "ip"
columns = [{ name = "intranet_ip", like = "10.%%" }]
to = "b"
"""


def test_split_and_daily(spark):
    alloc = A.allocation_config(RULES % "")
    src = ali(spark, [("2026-01-01", "ecs", "i", 200), ("2026-01-02", "ecs", "i", 200), ("2026-01-02", "oss", "o", 400)])
    detail = A.alloc_detail([src], JAN, alloc)
    lines = {r.line: (r.amount, r.daily, r.share) for r in A.allocate_costs(detail, None, JAN, alloc).collect()}
    # oss matches nothing: the table has no intranet_ip column, so that rule never holds
    assert lines == {"a": (300.0, 150.0, 0.375), "b": (100.0, 50.0, 0.125), None: (400.0, 200.0, 0.5)}
    assert A.daily_average(detail).head()[0] == 400.0
    shared = A.allocation_config(RULES % 'unmatched = "b"')
    assert {r.line: r.amount for r in A.allocate_costs(A.alloc_detail([src], JAN, shared), None, JAN, shared).collect()} == {"a": 300.0, "b": 500.0}


def test_each_cloud_has_its_own_days(spark):
    none = A.Alloc()
    detail = A.alloc_detail([ali(spark, [("2026-01-01", "x", "i", 100)]),
                             volc(spark, [("2026-01-01", "y", "a", 100, True), ("2026-01-02", "y", "a", 100, True), ("2026-01-03", "y", "b", 60, False)])], JAN, none)
    # blank days are money but no day
    assert A.daily_average(detail).head()[0] == 100.0 + 260.0 / 2
    monthly = A.alloc_detail([ali(spark, [("2026-01-01", "x", "i", 100)], daily=False), volc(spark, [("2026-01-01", "y", "a", 100, True)])], JAN, none)
    assert A.daily_average(monthly).head()[0] is None


PREPAID = 'lines = ["a"]\nunmatched = "a"\n[prepaid]\nsubscription = ["Subscription"]\n'


def test_prepaid_is_spread_over_its_months(spark):
    alloc = A.allocation_config(PREPAID)
    f = B.BillFilter("2026-01", "2026-01")
    src = ali(spark, [("2025-06-01", "ecs", "y", 1200, "Subscription", "1", "年"), ("2026-01-05", "ecs", "z", 31), ("2022-12-01", "old", "o", 100, "Subscription", "1", "年")])
    pre = A.prepaid_amortise([src], f, alloc)
    assert {r.period: r.amount for r in pre.collect()} == {f"2026-{m:02d}": 100.0 for m in range(1, 6)}
    detail = A.alloc_detail([src], f, alloc)
    line = A.allocate_costs(detail, pre, f, alloc).head()
    assert (line.amount, line.postpaid, line.amortized, line.daily) == (131.0, 31.0, 100.0, 31.0)
    est = A.monthly_estimate(A.allocate_costs(detail, pre, f, alloc), pre, alloc, "2026-02").head()
    assert est.estimate == 31.0 * 28 + 100
    # a five-year purchase keeps its length, the horizon is a year past the range
    long = A.prepaid_amortise([ali(spark, [("2026-01-01", "ecs", "y", 600, "Subscription", "5", "year")])], f, alloc)
    assert sorted(r.period for r in long.collect()) == [f"2026-{m:02d}" for m in range(1, 13)] + ["2027-01"] and long.head().amount == 10.0


def test_short_window(spark):
    alloc = A.allocation_config(PREPAID)
    src = ali(spark, [(f"2026-01-{d:02d}", "x", "i", 10) for d in range(1, 11)] + [("2026-01-01", "ecs", "y", 310, "Subscription", "1", "月")])
    pre = A.prepaid_amortise([src], JAN, alloc)
    line = A.allocate_costs(A.alloc_detail([src], JAN, alloc, window_days=7), pre, JAN, alloc, 7).head()
    assert (line.postpaid, line.daily, line.amortized) == (70.0, 10.0, 70.0)         # 310 × 7 / 31
    with pytest.raises(ValueError):
        A.alloc_detail([ali(spark, [], daily=False)], JAN, alloc, window_days=7)


@pytest.mark.parametrize("text", [
    "lines = []", 'lines = ["a", "a"]', 'lines = ["a"]\nunmatched = "b"', 'lines = ["a"]\nextra = 1', 'lines = ["a"]\n[[rules]]\nproduct = ["x"]',
    'lines = ["a"]\n[[rules]]\nto = "a"\nsplit = { a = 1 }', 'lines = ["a"]\n[[rules]]\nsplit = { a = 0 }', 'lines = ["a"]\n[[rules]]\nto = "z"',
    'lines = ["a"]\n[[rules]]\nto = "a"\nproduct = []', 'lines = ["a"]\n[[rules]]\nto = "a"\ncolumns = [{ name = "x" }]',
    'lines = ["a"]\n[[rules]]\nto = "a"\ncolumns = [{ name = "x", like = "a", any_of = ["b"] }]', 'lines = ["a"]\n[[include]]\nto = "a"',
    'lines = ["a"]\n[prepaid]\nlookback_months = 3', 'lines = ["a"]\n[prepaid]\nproduct = ["x"]\nlookback_months = 500',
    'lines = ["a"]\n[[rules]]\nto = "a"\nprovider = "other"', "not toml at all ===",
])
def test_bad_rules(text):
    with pytest.raises(A.AllocError):
        A.allocation_config(text)


def test_many_rules(spark):
    rules = "".join(f'[[rules]]\nproduct = ["p{i}"]\nto = "a"\n' for i in range(200))
    alloc = A.allocation_config('lines = ["a"]\n' + rules)
    detail = A.alloc_detail([ali(spark, [("2026-01-01", "p199", "i", 1), ("2026-01-01", "zz", "j", 1), ("2026-01-01", "p0", "k", 1)])], JAN, alloc)
    assert sorted(r.rule for r in detail.collect()) == [-1, 0, 199]
    with pytest.raises(A.AllocError):
        A.allocation_config('lines = ["a"]\n' + rules + '[[rules]]\nto = "a"\n')


def test_sections_and_summary(spark):
    alloc = A.allocation_config(PREPAID)
    f = B.BillFilter("2026-01", "2026-02")
    src = ali(spark, [("2026-01-01", "x", "i", 10), ("2026-02-01", "x", "i", 30), ("2026-01-01", "e", "y", 24, "Subscription", "1", "年")])
    monthly = A.alloc_monthly(A.alloc_detail([src], f, alloc), A.prepaid_amortise([src], f, alloc), f, alloc)
    s = A.alloc_section(monthly, f, "alicloud", "postpaid").head()
    assert (s["2026-01"], s["2026-02"], s.subtotal, s.share) == (10.0, 30.0, 40.0, 1.0)
    rows = {(r.period, r.tone, r.kind): r.amount for r in A.alloc_summary(monthly).collect()}
    assert rows["2026-01", "plain", "prepaid"] == 2.0 and rows["2026-02", "sub", None] == 32.0 and rows["2026-01", "total", None] == 12.0


# --- days ----------------------------------------------------------------------------------------

TODAY = date(2026, 1, 20)


def days(spark, rows):
    return spark.createDataFrame([(p, prod, f"2026-01-{d:02d}", float(v)) for p, prod, d, v in rows], "provider string, product string, day string, amount double")


def test_compare_ends_where_every_cloud_has_billed(spark):
    pd = days(spark, [("volcengine", "v", 19, 5), ("volcengine", "v", 18, 4), ("volcengine", "v", 17, 3), ("alicloud", "a", 18, 10), ("alicloud", "a", 17, 20)])
    assert A.default_end(pd, TODAY, "day").head()[0] == "2026-01-18"
    rows = {r.product: (r.current, r.previous, r.delta, r.change_pct, r.pending) for r in A.cost_compare(pd, TODAY).collect()}
    assert rows == {"a": (10.0, 20.0, -10.0, -50.0, False), "v": (4.0, 3.0, 1.0, 33.3, False)}
    late = {r.product: r.pending for r in A.cost_compare(pd, TODAY, "day", "2026-01-19").collect()}
    assert late == {"a": True, "v": False}


def test_today_is_never_the_default(spark):
    assert A.default_end(days(spark, [("alicloud", "a", 20, 1), ("volcengine", "v", 20, 1)]), TODAY, "day").head()[0] == "2026-01-19"


def test_gaps_switch_to_daily_figures(spark):
    pd = days(spark, [("alicloud", "a", d, 10) for d in range(8, 15)] + [("alicloud", "a", d, 10) for d in (1, 2, 3, 4)])
    r = A.cost_compare(pd, TODAY, "7d", "2026-01-14").head()
    assert (r.basis, r.current, r.previous, r.delta) == ("daily", 10.0, 10.0, 0.0)
    full = A.cost_compare(days(spark, [("alicloud", "a", d, 10) for d in range(1, 15)]), TODAY, "7d", "2026-01-14").head()
    assert (full.basis, full.current) == ("total", 70.0)


def test_trend_and_matrix(spark):
    pd = days(spark, [("alicloud", "a", d, d) for d in range(1, 15)] + [("alicloud", "zero", 3, 0)])
    span = {r.day: (r.value, r.previous_day, r.previous) for r in A.product_trend(pd, "7d", "2026-01-14").where("product = 'a'").collect()}
    assert len(span) == 7 and span["2026-01-14"] == (14.0, "2026-01-07", 7.0)
    marks = {r.day for r in A.product_trend(pd, "week", "2026-01-14").where("mark").collect()}
    assert marks == {"2026-01-14", "2026-01-07"}
    m = A.product_matrix(pd, TODAY, 10).collect()
    assert [(r.product, r.amounts) for r in m] == [("a", [11.0, 12.0, 13.0, 14.0] + [0.0] * 6)]


def test_product_days_and_day_drill(spark):
    src = ali(spark, [("2026-01-19", "x", "i", 3), ("2026-01-18", "x", "i", 2), ("2026-01-25", "x", "i", 9)])
    assert {r.day: r.amount for r in A.product_days([src], TODAY, days=5).collect()} == {"2026-01-18": 2.0, "2026-01-19": 3.0}
    r = A.allocation_day([src], "2026-01-19", A.Alloc()).head()
    assert (r.product, r.current, r.previous, r.line) == ("x", 3.0, 2.0, None)
    assert A.monthly_only([src]) == [] and A.monthly_only([ali(spark, [], daily=False)]) == ["alicloud"]


def test_constant_key_columns_cost_no_further_exchange(spark):
    rows = [("2026-01-01", "x", "i", 1), ("2026-01-01", "x", "i", 1, "PayAsYouGo", "1", "月", 86_400), ("2026-01-02", "x", None, 2)]
    src = ali(spark, rows, keys=("billing_date", "instance_id", "zone", "subscription_type"))
    src = B.BillSource(src.kind, src.df.withColumn("subscription_type", F.lit("PayAsYouGo")), src.keys)
    lines = B.normalize_bill(src, JAN)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.day, float(r.amount), float(r.original)) for r in lines.collect()) == [("2026-01-01", 1.0, 2.0), ("2026-01-02", 2.0, 4.0)]


def test_export_of_more_rows_than_a_task_may_hold(spark, monkeypatch):
    from telespark.functions import limits

    rows = [(f"2026-01-{1 + i % 28:02d}", f"p{i % 7}", f"i{i}", i * 37 % 101) for i in range(200)]
    src = ali(spark, rows)
    whole = B.export_bills(src, JAN).collect()
    assert len(whole) == 200 and "TakeOrderedAndProject" in B.export_bills(src, JAN, limit=60)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(limits, "IN_MEMORY", 10)
    for n in (11, 60, 199, 200, 500):
        part = B.export_bills(src, JAN, limit=n)
        assert "TakeOrderedAndProject" not in part._jdf.queryExecution().executedPlan().toString()
        assert part.collect() == whole[:n]
    assert B.export_bills(ali(spark, []), JAN, limit=60).count() == 0
