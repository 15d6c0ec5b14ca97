"""Bill queries over the derived provider tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from telespark.functions.lineage import materialize
from telespark.operators import allocation as A
from telespark.operators import apportion
from telespark.operators import bills as B
from telespark.plans import sqlviews, views
from telespark.plans.registry import query
from telespark.sources.schema import BillTable, BillTables

FIRST, LAST = "2024-01", "2026-06"            # every month of the derived bills
ALL = B.BillFilter(FIRST, LAST)
TODAY = date(2026, 6, 20)


def _tables(spark, sf_dir, *kinds):
    make = {
        "volcengine": lambda: BillTable(views.volcengine_bill(spark, sf_dir), ["ExpenseDate", "line_id"]),
        "alicloud_monthly": lambda: BillTable(views.alicloud_bill(spark, sf_dir, daily=False), ["billing_cycle", "line_id"]),
        "alicloud_daily": lambda: BillTable(views.alicloud_bill(spark, sf_dir), ["billing_date", "line_id"])}
    return BillTables({k: make[k]() for k in kinds or make})


def _monthly(spark, sf_dir, **kw):
    return B.pick_sources(_tables(spark, sf_dir, "volcengine", "alicloud_monthly"), **kw)


def _daily(spark, sf_dir, **kw):
    return B.pick_sources(_tables(spark, sf_dir, "volcengine", "alicloud_daily"), by_day=True, **kw)


def _ali(spark, sf_dir):
    return B.pick_sources(_tables(spark, sf_dir, "alicloud_daily"), by_day=True)[0]


def _volc(spark, sf_dir, **kw):
    return B.pick_sources(_tables(spark, sf_dir, "volcengine"), by_day=True, **kw)[0]


# volcengine lines have days in either reading
sqlviews.VIEWS["bill_sum"] = """select * from bill_m where provider = 'alicloud' union all by name select * from bill_d where provider = 'volcengine'"""


@query("bill_periods", "select period, period = max(period) over () as latest from (select distinct period from bill)")
def bill_periods(spark, sf_dir):
    return B.bill_periods(_monthly(spark, sf_dir), ALL)


@query("bill_dedupe_group", """
select provider, day, n as line_id, payable_e4 / 10000.0::double as amount, original_e4 / 10000.0::double as original, paid_e4 / 10000.0::double as paid from bill_d""")
def bill_dedupe_group(spark, sf_dir):
    out = None
    for src in _daily(spark, sf_dir):
        one = B.normalize_bill(src, ALL, extra={"line_id": F.col("line_id")}).select("provider", "day", "line_id", "amount", "original", "paid")
        out = one if out is None else out.unionByName(one)
    return out.withColumns({c: F.col(c).cast("double") for c in ("amount", "original", "paid")})


@query("bill_dedupe_final", """
select day, count(*) as lines, sum(payable_e4) / 10000.0::double as amount from (select *, row_number() over
  (partition by day, n order by sync_s desc, provider desc, period desc, day desc, product desc, item desc, instance_id desc) as rn from bill where provider = 'volcengine')
where rn = 1 group by 1""")
def bill_dedupe_final(spark, sf_dir):
    rows = B.normalize_bill(_volc(spark, sf_dir, mode="final"), ALL)
    return rows.groupBy("day").agg(F.count("*").alias("lines"), F.sum("amount").cast("double").alias("amount"))


@query("bill_dedupe_off", "select provider, period, count(*) as lines, sum(paid_e4) / 10000.0::double as paid from bill group by all")
def bill_dedupe_off(spark, sf_dir):
    rows = B.bill_lines(_daily(spark, sf_dir, mode="off"), ALL)
    return rows.groupBy("provider", "period").agg(F.count("*").alias("lines"), F.sum("paid").cast("double").alias("paid"))


SUMMARY = """select period, coalesce(sum(payable_e4) filter (provider = 'volcengine'), 0) / 10000.0::double as volcengine,
  coalesce(sum(payable_e4) filter (provider = 'alicloud'), 0) / 10000.0::double as alicloud, sum(payable_e4) / 10000.0::double as total from bill_sum group by 1"""


@query("cost_summary", SUMMARY)
def cost_summary(spark, sf_dir):
    return B.cost_summary(B.bill_lines(_monthly(spark, sf_dir), ALL), ALL)


@query("cost_month_over_month", f"""
select period, total, lag(total) over (order by period) as previous, round((total - lag(total) over (order by period)) / lag(total) over (order by period), 9) as change from ({SUMMARY})""")
def cost_month_over_month(spark, sf_dir):
    out = B.month_over_month(B.cost_summary(B.bill_lines(_monthly(spark, sf_dir), ALL), ALL))
    return out.withColumn("change", F.round("change", 9))


@query("cost_daily", "select day, provider, sum(original_e4) / 10000.0::double as amount from bill_d group by all")
def cost_daily(spark, sf_dir):
    return B.cost_daily(B.bill_lines(_daily(spark, sf_dir), ALL, "original"))


def _breakdown(column: str, k: int) -> str:
    return f"""
with p as (select case when {column} = '' then '(empty)' else {column} end as key, sum(payable_e4) as a,
    sum(payable_e4) filter (provider = 'volcengine') as v, sum(payable_e4) filter (provider = 'alicloud') as l from bill_sum group by 1),
t as (select * from p order by a desc, key limit {k}), s as (select sum(a) as total, (select sum(a) from t) as listed from p)
select key, a / 10000.0::double as amount, round(a / total::double, 9) as share, v / 10000.0::double as volcengine, l / 10000.0::double as alicloud,
  round(greatest(0, total - listed) / 10000.0::double, 2) as other, round(total / 10000.0::double, 2) as total from t, s"""


def _rounded(df):
    return df.withColumns({"share": F.round("share", 9), "other": F.round("other", 2), "total": F.round("total", 2)})


@query("cost_breakdown_product", _breakdown("product", 6))
def cost_breakdown_product(spark, sf_dir):
    return _rounded(B.cost_breakdown(B.bill_lines(_monthly(spark, sf_dir), ALL), "product", 6))


@query("cost_breakdown_region", _breakdown("region", 20))
def cost_breakdown_region(spark, sf_dir):
    return _rounded(B.cost_breakdown(B.bill_lines(_monthly(spark, sf_dir), ALL), "region", 20))


@query("cost_filtered", """
select item, sum(payable_e4) / 10000.0::double as amount from bill_d where provider = 'alicloud' and product in ('ECONOMY', 'c-SMALL')
  and (contains(lower(product), 'brand#1') or contains(lower(item), 'brand#1') or contains(lower(instance_id), 'brand#1'))
  and day between '2024-03-05' and '2026-02-14' group by 1""")
def cost_filtered(spark, sf_dir):
    f = B.BillFilter(FIRST, LAST, {"product": ("ECONOMY", "c-SMALL")}, "BRAND#1", ("2024-03-05", "2026-02-14"))
    rows = B.normalize_bill(_ali(spark, sf_dir), f)
    return rows.groupBy("item").agg(F.sum("amount").cast("double").alias("amount"))


DETAIL = """select period, day, product, item, instance_id, region, zone, account, project, subscription, usage, payable_e4 / 10000.0::double as amount,
  original_e4 / 10000.0::double as original, paid_e4 / 10000.0::double as paid, cast(n as varchar) as line from bill_d where provider = '%s' """
SHOWN = ("period", "day", "product", "item", "instance_id", "region", "zone", "account", "project", "subscription", "usage", "amount", "original", "paid")


@query("bill_detail_page", DETAIL % "alicloud" + """
order by payable_e4 desc, period desc, product, day, instance_id, item, usage, original_e4 limit 50 offset 20""")
def bill_detail_page(spark, sf_dir):
    out = B.bill_detail(_ali(spark, sf_dir), ALL, raw=("line_id", "region"), limit=50, offset=20)
    return out.select(*SHOWN, F.col("extra")["line_id"].alias("line"))


@query("bill_detail_by_discount", DETAIL % "volcengine" + """
order by original_e4 - payable_e4 desc, payable_e4 desc, period desc, product, day, instance_id, item, usage, original_e4 limit 100""")
def bill_detail_by_discount(spark, sf_dir):
    out = B.bill_detail(_volc(spark, sf_dir), ALL, sort="discount", raw=("line_id",), limit=100)
    return out.select(*SHOWN, F.col("extra")["line_id"].alias("line"))


@query("bill_detail_by_usage", DETAIL % "alicloud" + """
order by cast(usage as double), payable_e4 desc, period desc, product, day, instance_id, item, usage, original_e4 limit 100""")
def bill_detail_by_usage(spark, sf_dir):
    out = B.bill_detail(_ali(spark, sf_dir), ALL, sort="usage", desc=False, raw=("line_id",), limit=100)
    return out.select(*SHOWN, F.col("extra")["line_id"].alias("line"))


@query("bill_detail_by_raw", DETAIL % "alicloud" + """
order by n desc, payable_e4 desc, period desc, product, day, instance_id, item, usage, original_e4 limit 100""")
def bill_detail_by_raw(spark, sf_dir):
    out = B.bill_detail(_ali(spark, sf_dir), ALL, sort="raw:line_id", raw=("line_id",), limit=100)
    return out.select(*SHOWN, F.col("extra")["line_id"].alias("line"))


@query("bill_export", DETAIL.replace("cast(n as varchar) as line", "cast(n as varchar) as line_id, region as raw_region") % "alicloud")
def bill_export(spark, sf_dir):
    out = B.export_bills(_ali(spark, sf_dir), ALL, raw=("line_id", "region"))        # all lines, as in the twin
    return out.select(*SHOWN, "line_id", F.col("`raw.region`").alias("raw_region"))


@query("bill_count", "select count(*) as rows from bill_d where provider = 'alicloud'")
def bill_count(spark, sf_dir):
    return B.bill_count(_ali(spark, sf_dir), ALL)


@query("bill_facets", """
select * exclude (rn) from (select *, row_number() over (partition by dim order by count desc, value) as rn from (
  select 'product' as dim, product as value, count(*) as count from bill where provider = 'alicloud' and region in ('CHINA', 'PERU', 'KENYA') and project = 'proj-1' group by all
  union all select 'region', region, count(*) from bill where provider = 'alicloud' and product in ('ECONOMY', 'SMALL') and project = 'proj-1' and region <> '' group by all
  union all select 'item', item, count(*) from bill where provider = 'alicloud' and product in ('ECONOMY', 'SMALL') and region in ('CHINA', 'PERU', 'KENYA') and project = 'proj-1' group by all))
where rn <= 10""")
def bill_facets(spark, sf_dir):
    f = B.BillFilter(FIRST, LAST, {"product": ("ECONOMY", "SMALL"), "region": ("CHINA", "PERU", "KENYA"), "project": ("proj-1",)})
    return B.bill_facets(_ali(spark, sf_dir), f, ("product", "region", "item"), 10)


@query("bill_coverage", """
with d as (select sum(payable_e4) as v from bill_d where provider = 'alicloud'), m as (select sum(payable_e4) as v from bill_m where provider = 'alicloud')
select d.v / 10000.0::double as daily, m.v / 10000.0::double as monthly, d.v < m.v * 0.95 as incomplete from d, m""")
def bill_coverage(spark, sf_dir):
    t = _tables(spark, sf_dir, "alicloud_monthly", "alicloud_daily")
    return B.coverage_check(B.pick_sources(t, by_day=True)[0], B.pick_sources(t)[0], ALL)


@query("bill_coverage_gap", """
with d as (select sum(payable_e4) as v from bill_d where provider = 'alicloud' and day between '2024-01-01' and '2025-06-30'),
 m as (select sum(payable_e4) as v from bill_m where provider = 'alicloud')
select d.v / 10000.0::double as daily, m.v / 10000.0::double as monthly, d.v < m.v * 0.95 as incomplete from d, m""")
def bill_coverage_gap(spark, sf_dir):
    t = _tables(spark, sf_dir, "alicloud_monthly", "alicloud_daily")
    f = B.BillFilter(FIRST, LAST, days=("2024-01-01", "2025-06-30"))       # days do not narrow the monthly table
    return B.coverage_check(B.pick_sources(t, by_day=True)[0], B.pick_sources(t)[0], f)


# --- allocation -------------------------------------------------------------------------------

RULES = """
lines = ["alpha", "beta", "gamma", "shared"]
%s
[prepaid]
subscription = ["Subscription"]
[[rules]]
name = "machines"
provider = "alicloud"
product = ["ECONOMY"]
columns = [{ name = "intranet_ip", any_of = ["10.0.1.2", "10.0.1.4", "10.0.1.6"] }, { name = "line_id", not_like = "%%7" }]
to = "beta"
[[rules]]
name = "rest"
product = ["ECONOMY"]
split = { alpha = 130, beta = 400, gamma = 1200 }
[[rules]]
name = "brands"
columns = [{ name = "product_detail", like = "Brand#1%%" }]
to = "gamma"
[[rules]]
name = "small"
provider = "volcengine"
product = ["SMALL"]
to = "beta"
[[rules]]
name = "thirds"
product = ["STANDARD"]
split = { gamma = 1, alpha = 1, beta = 1 }
"""
ALLOC = A.allocation_config(RULES % 'unmatched = "shared"')
LOOSE = A.allocation_config(RULES % "")
RULE = """case when provider = 'alicloud' and product = 'ECONOMY' and ip in ('10.0.1.2', '10.0.1.4', '10.0.1.6') and not cast(n as varchar) like '%7' then 0
  when product = 'ECONOMY' then 1 when provider = 'alicloud' and item like 'Brand#1%' then 2 when provider = 'volcengine' and product = 'SMALL' then 3
  when product = 'STANDARD' then 4 else -1 end"""
sqlviews.VIEWS["shares"] = """select * from (values (0, 'machines', 'beta', 1.0::double), (1, 'rest', 'alpha', 130 / 1730.0::double),
  (1, 'rest', 'beta', 400 / 1730.0::double), (1, 'rest', 'gamma', 1200 / 1730.0::double), (2, 'brands', 'gamma', 1.0), (3, 'small', 'beta', 1.0),
  (4, 'thirds', 'alpha', 1 / 3.0::double), (4, 'thirds', 'beta', 1 / 3.0::double), (4, 'thirds', 'gamma', 1 / 3.0::double), (-1, null, 'shared', 1.0)) v(rule, rule_name, line, part)"""
sqlviews.VIEWS["adetail"] = f"""
select provider, {RULE} as rule, product, day as bucket, period, sum(payable_e4) / 10000.0::double as amount from bill_d
where not (provider = 'alicloud' and subscription = 'Subscription') group by all"""
sqlviews.VIEWS["apre"] = f"""
select provider, rule, product, strftime(cast(period || '-01' as date) + to_months(cast(k as int)), '%Y-%m') as period, sum(amount / months) as amount
from (select *, unnest(range(months)) as k from (
      select provider, {RULE} as rule, product, period, months, sum(payable_e4) / 10000.0::double as amount
      from bill_m where provider = 'alicloud' and subscription = 'Subscription' group by all))
where strftime(cast(period || '-01' as date) + to_months(cast(k as int)), '%Y-%m') between '{FIRST}' and '2027-06' group by all"""
sqlviews.VIEWS["aday"] = "select provider, count(distinct bucket) as days from adetail group by 1"
sqlviews.VIEWS["amoney"] = f"""
select provider, rule, product, amount, amount / days as daily, false as prepaid from adetail join aday using (provider)
union all select provider, rule, product, amount, null, true from apre where period <= '{LAST}'"""


def _units(name: str) -> str:
    return f"floor(round({name}, 4) + 0.123456)"


def _in_units(df, *cols):
    """Whole units with an off-grid threshold, so that sums in another order agree."""
    return df.withColumns({c: F.floor(F.round(c, 4) + 0.123456) for c in cols})


def _detail(spark, sf_dir, alloc=ALLOC, once=False, **kw):
    detail = A.alloc_detail(_daily(spark, sf_dir), ALL, alloc, **kw)
    return materialize(detail) if once else detail


def _prepaid(spark, sf_dir, alloc=ALLOC):
    t = _tables(spark, sf_dir)
    monthly = B.pick_sources(t, ("alicloud",))[0]
    return A.prepaid_amortise(A.prepaid_sources(B.pick_sources(t, by_day=True), monthly), ALL, alloc)


@query("alloc_detail", "select * from adetail")
def alloc_detail(spark, sf_dir):
    return _detail(spark, sf_dir).drop("has_days").withColumn("amount", F.col("amount").cast("double"))


@query("alloc_detail_included", f"""
select provider, {RULE} as rule, product, sum(payable_e4) / 10000.0::double as amount from bill_d where not (provider = 'alicloud' and subscription = 'Subscription')
 and (account = 'acct-1' or (provider = 'alicloud' and zone = 'z2')) group by all""")
def alloc_detail_included(spark, sf_dir):
    alloc = A.allocation_config(RULES.replace("[prepaid]", '[[include]]\naccount = ["acct-1"]\n[[include]]\nprovider = "alicloud"\nzone = ["z2"]\n[prepaid]') % "")
    rows = _detail(spark, sf_dir, alloc).groupBy("provider", "rule", "product").agg(F.sum("amount").cast("double").alias("amount"))
    return rows


@query("alloc_by_period", "select provider, rule, period, round(sum(amount), 4) as amount from adetail group by all")
def alloc_by_period(spark, sf_dir):
    return A.alloc_by_period(_detail(spark, sf_dir))


@query("alloc_prepaid", f"select provider, rule, product, period, {_units('amount')} as amount from apre")
def alloc_prepaid(spark, sf_dir):
    return _in_units(_prepaid(spark, sf_dir), "amount")


@query("alloc_lines", f"""
select line, {_units('sum(amount * part)')} as amount, {_units('sum(amount * part) filter (not prepaid)')} as postpaid,
  {_units('coalesce(sum(amount * part) filter (prepaid), 0)')} as amortized, {_units('sum(daily * part)')} as daily,
  round(sum(amount * part) / (select sum(amount) from amoney), 9) as share from amoney join shares using (rule) group by 1""")
def alloc_lines(spark, sf_dir):
    out = A.allocate_costs(_detail(spark, sf_dir, once=True), _prepaid(spark, sf_dir), ALL, ALLOC)
    return _in_units(out, "amount", "postpaid", "amortized", "daily").withColumn("share", F.round("share", 9))


@query("alloc_items", f"""
select line, product, rule_name, prepaid, {_units('sum(amount * part)')} as amount, {_units('sum(daily * part)')} as daily
from amoney join shares using (rule) group by 1, 2, 3, 4""")
def alloc_items(spark, sf_dir):
    out = A.alloc_items(_detail(spark, sf_dir, once=True), _prepaid(spark, sf_dir), ALL, ALLOC)
    return _in_units(out, "amount", "daily").drop("share")


@query("alloc_products", f"""
select product, prepaid, {_units('sum(amount)')} as amount, {_units('sum(daily)')} as daily, {_units('coalesce(sum(amount) filter (rule = -1), 0)')} as unmatched
from amoney group by 1, 2""")
def alloc_products(spark, sf_dir):
    return _in_units(A.alloc_products(_detail(spark, sf_dir, once=True), _prepaid(spark, sf_dir), ALL), "amount", "daily", "unmatched")


@query("alloc_points", f"select bucket, line, {_units('sum(amount * part)')} as amount from adetail join shares using (rule) group by 1, 2")
def alloc_points(spark, sf_dir):
    return _in_units(A.alloc_points(_detail(spark, sf_dir), ALLOC), "amount")


@query("alloc_unmatched_loose", f"select case when line = 'shared' then null else line end as line, {_units('sum(amount * part)')} as amount from adetail join shares using (rule) group by 1")
def alloc_unmatched_loose(spark, sf_dir):
    rows = A.spread(_detail(spark, sf_dir, LOOSE), LOOSE).groupBy("line").agg(F.sum("amount").alias("amount"))
    return _in_units(rows, "amount")


@query("alloc_daily_average", f"select {_units('sum(amount / days)')} as daily from adetail join aday using (provider)")
def alloc_daily_average(spark, sf_dir):
    return _in_units(A.daily_average(_detail(spark, sf_dir, once=True)), "daily")


WINDOWED = f"""
with w as (select b.provider, {RULE} as rule, product, payable_e4 / 10000.0::double as amount, day from bill_d b
  join (select provider, max(day) as last from bill group by 1) l on l.provider = b.provider
  where not (b.provider = 'alicloud' and subscription = 'Subscription') and cast(day as date) >= cast(last as date) - 29),
m as (select provider, rule, product, amount, amount / days as daily, false as prepaid from w join (select provider, count(distinct day) as days from w group by 1) using (provider)
  union all select provider, rule, product, amount * 30 / 912.0, null, true from apre where period <= '{LAST}')"""


@query("alloc_lines_last_days", WINDOWED.replace("b.provider, case when provider", "b.provider, case when b.provider").replace(
    "when provider", "when b.provider").replace("case when provider", "case when b.provider") + f"""
select line, {_units('sum(amount * part)')} as amount, {_units('sum(daily * part)')} as daily from m join shares using (rule) group by 1""")
def alloc_lines_last_days(spark, sf_dir):
    out = A.allocate_costs(_detail(spark, sf_dir, once=True, window_days=30), _prepaid(spark, sf_dir), ALL, ALLOC, 30)
    return _in_units(out, "amount", "daily").select("line", "amount", "daily")


@query("alloc_monthly_estimate", f"""
select line, floor((sum(daily * part) * 31 + coalesce((select sum(a.amount * s.part) from apre a join shares s using (rule) where a.period = '2026-07' and s.line = shares.line), 0)) / 10) as estimate
from amoney join shares using (rule) group by 1""")
def alloc_monthly_estimate(spark, sf_dir):
    detail, pre = _detail(spark, sf_dir, once=True), materialize(_prepaid(spark, sf_dir))
    out = A.monthly_estimate(A.allocate_costs(detail, pre, ALL, ALLOC), pre, ALLOC, "2026-07")
    return out.select("line", F.floor(F.col("estimate") / 10).alias("estimate"))


sqlviews.VIEWS["amonth"] = f"""
select provider, kind, line, period, sum(amount * part) as amount from (
  select provider, rule, period, amount, 'postpaid' as kind from adetail union all
  select provider, rule, period, amount, 'prepaid' from apre where period <= '{LAST}') join shares using (rule) group by all"""


def _months(spark, sf_dir):
    return materialize(A.alloc_monthly(_detail(spark, sf_dir), _prepaid(spark, sf_dir), ALL, ALLOC))


@query("alloc_monthly", f"select provider, kind, line, period, {_units('amount')} as amount from amonth")
def alloc_monthly(spark, sf_dir):
    return _in_units(_months(spark, sf_dir), "amount")


@query("alloc_section", f"""
select line, {', '.join(f"{_units(f'''coalesce(sum(amount) filter (period = '{p}'), 0)''')} as \"{p}\"" for p in ('2024-01', '2025-06', '2026-06'))},
  floor(sum(amount) / 10) as subtotal, round(sum(amount) / (select sum(amount) from amonth where provider = 'alicloud' and kind = 'prepaid'), 9) as share
from amonth where provider = 'alicloud' and kind = 'prepaid' group by 1""")
def alloc_section(spark, sf_dir):
    out = A.alloc_section(_months(spark, sf_dir), ALL, "alicloud", "prepaid")
    shown = ("2024-01", "2025-06", "2026-06")
    return out.select("line", *[F.floor(F.round(F.col(f"`{p}`"), 4) + 0.123456).alias(p) for p in shown],
                      F.floor(F.col("subtotal") / 10).alias("subtotal"), F.round("share", 9).alias("share"))


@query("alloc_summary", f"""
select period, provider, kind, 'plain' as tone, {_units('sum(amount)')} as amount from amonth group by 1, 2, 3
union all select period, provider, null, 'sub', {_units('sum(amount)')} from amonth group by 1, 2
union all select period, null, null, 'total', {_units('sum(amount)')} from amonth group by 1""")
def alloc_summary(spark, sf_dir):
    return _in_units(A.alloc_summary(_months(spark, sf_dir)), "amount")


DAY = "2025-03-01"


@query("alloc_day", f"""
select * from (select line, provider, product, rule_name, {_units(f"coalesce(sum(amount * part) filter (bucket = '{DAY}'), 0)")} as current,
  {_units("coalesce(sum(amount * part) filter (bucket = '2025-02-28'), 0)")} as previous
from adetail join shares using (rule) where bucket in ('{DAY}', '2025-02-28') group by 1, 2, 3, 4)""")
def alloc_day(spark, sf_dir):
    return _in_units(A.allocation_day(_daily(spark, sf_dir), DAY, ALLOC), "current", "previous")


# --- day matrices and comparisons -------------------------------------------------------------------

sqlviews.VIEWS["pdays"] = """
select provider, product, bucket as day, round(sum(amount), 4) as amount from adetail where bucket between '2026-04-20' and '2026-06-20' group by all"""


def _pdays(spark, sf_dir):
    return A.product_days(_daily(spark, sf_dir), TODAY, ALLOC)


@query("product_days", "select * from pdays")
def product_days(spark, sf_dir):
    return _pdays(spark, sf_dir)


@query("product_matrix", """
select provider, product, array_to_string(list(cast(cast(round(coalesce(amount, 0) * 100) as bigint) as varchar) order by d), ',') as line from
  (select distinct provider, product from pdays) cross join (select strftime(date '2026-04-20' + cast(i as int), '%Y-%m-%d') as d from range(62) r(i))
  left join pdays using (provider, product) where false group by all
union all select provider, product, array_to_string(list(cast(cast(round(coalesce(a, 0) * 100) as bigint) as varchar) order by d), ',') from (
  select k.provider, k.product, x.d, p.amount as a from (select distinct provider, product from pdays) k
  cross join (select strftime(date '2026-04-20' + cast(i as int), '%Y-%m-%d') as d from range(62) r(i)) x
  left join pdays p on p.provider = k.provider and p.product = k.product and p.day = x.d) group by all""")
def product_matrix(spark, sf_dir):
    out = A.product_matrix(_pdays(spark, sf_dir), TODAY)
    return out.select("provider", "product", F.array_join(F.transform("amounts", lambda v: F.round(v * 100).cast("bigint").cast("string")), ",").alias("line"))


@query("product_last_billed_day", "select provider, max(day) as last_day from pdays group by 1")
def product_last_billed_day(spark, sf_dir):
    return A.last_billed_day(_pdays(spark, sf_dir))


def _compare(width: int, back: int) -> str:
    return f"""
with e as (select least(min(last), '2026-06-19') as ed from (select provider, max(day) as last from pdays group by 1)),
x as (select p.*, date_diff('day', cast(day as date), cast(ed as date)) as ago, ed from pdays p, e),
d as (select count(distinct day) filter (ago between 0 and {width - 1}) as c, count(distinct day) filter (ago between {back} and {back + width - 1}) as p
  from (select day, ago, sum(amount) as t from x group by all) where t <> 0),
s as (select x.provider, product, ed, coalesce(sum(amount) filter (ago between 0 and {width - 1}), 0) as c0,
  coalesce(sum(amount) filter (ago between {back} and {back + width - 1}), 0) as p0 from x group by all),
z as (select s.*, case when {width} > 1 and d.c > 0 and d.p > 0 and d.c <> d.p then 'daily' else 'total' end as basis, d.c as dc, d.p as dp from s, d),
y as (select *, case basis when 'daily' then c0 / dc else c0 end as cur, case basis when 'daily' then p0 / dp else p0 end as prev from z)
select provider, product, {_units('cur')} as current, {_units('prev')} as previous, basis, ed as "end",
  (select max(day) from pdays q where q.provider = y.provider) < ed as pending from y where cur <> 0 or prev <> 0"""


def _shown(df):
    # figures are rounded to cents by the operator; the check looks at whole units
    return df.drop("delta", "change_pct")


@query("cost_compare_day", _compare(1, 1).replace(_units('cur'), "round(cur, 2)").replace(_units('prev'), "round(prev, 2)"))
def cost_compare_day(spark, sf_dir):
    return _shown(A.cost_compare(_pdays(spark, sf_dir), TODAY, "day"))


@query("cost_compare_week", _compare(1, 7).replace(_units('cur'), "round(cur, 2)").replace(_units('prev'), "round(prev, 2)"))
def cost_compare_week(spark, sf_dir):
    return _shown(A.cost_compare(_pdays(spark, sf_dir), TODAY, "week"))


@query("cost_compare_30d", _compare(30, 30).replace(_units('cur'), "floor(cur + 0.123)").replace(_units('prev'), "floor(prev + 0.123)"))
def cost_compare_30d(spark, sf_dir):
    out = _shown(A.cost_compare(_pdays(spark, sf_dir), TODAY, "30d"))
    return out.withColumns({c: F.floor(F.col(c) + 0.123) for c in ("current", "previous")})


@query("product_trend_span", """
select p.provider, p.product, strftime(e - cast(k as int), '%Y-%m-%d') as day, coalesce(a.amount, 0) as value,
  strftime(e - cast(k as int) - 7, '%Y-%m-%d') as previous_day, coalesce(b.amount, 0) as previous
from (select distinct provider, product from pdays) p cross join (select date '2026-06-15' as e, unnest(range(7)) as k) x
left join pdays a on a.provider = p.provider and a.product = p.product and a.day = strftime(e - cast(k as int), '%Y-%m-%d')
left join pdays b on b.provider = p.provider and b.product = p.product and b.day = strftime(e - cast(k as int) - 7, '%Y-%m-%d')""")
def product_trend_span(spark, sf_dir):
    return A.product_trend(_pdays(spark, sf_dir), "7d", "2026-06-15")


@query("product_trend_day", """
select p.provider, p.product, strftime(e - cast(k as int), '%Y-%m-%d') as day, coalesce(a.amount, 0) as value, k in (0, 7) as mark
from (select distinct provider, product from pdays) p cross join (select date '2026-06-15' as e, unnest(range(14)) as k) x
left join pdays a on a.provider = p.provider and a.product = p.product and a.day = strftime(e - cast(k as int), '%Y-%m-%d')""")
def product_trend_day(spark, sf_dir):
    return A.product_trend(_pdays(spark, sf_dir), "week", "2026-06-15")


@query("service_months", """
select unit, amount, case unit when '年' then amount * 12 when 'month' then amount when 'days' then greatest(1, round(amount / 30.0)) when '小时' then 1
  when 'seconds' then greatest(1, cast(round(amount * 1000000 / 86400.0 / 30) as int)) else 1 end as months, count(*) as lines
from (select case l_partkey % 6 when 0 then '年' when 1 then 'month' when 2 then 'days' when 3 then '小时' when 4 then 'seconds' else 'moon' end as unit,
        cast(l_quantity as int) as amount from lineitem) group by all""")
def service_months(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").selectExpr(
        "case l_partkey % 6 when 0 then '年' when 1 then 'month' when 2 then 'days' when 3 then '小时' when 4 then 'seconds' else 'moon' end as unit",
        "cast(l_quantity as int) as amount")
    text = F.when(F.col("unit") == "seconds", F.concat(F.col("amount").cast("string"), F.lit("000000"))).otherwise(F.col("amount").cast("string"))
    return (li.withColumn("months", B.service_months(text, F.col("unit"))).groupBy("unit", "amount", "months").agg(F.count("*").alias("lines")))


# --- exact apportionment: whole units of 10^-8 ------------------------------------------------------

sqlviews.VIEWS["wholeshares"] = """select * from (values (0, 'beta', 1, 1, 1), (1, 'alpha', 0, 13, 173), (1, 'beta', 1, 40, 173), (1, 'gamma', 2, 120, 173), (2, 'gamma', 2, 1, 1),
  (3, 'beta', 1, 1, 1), (4, 'alpha', 0, 1, 3), (4, 'beta', 1, 1, 3), (4, 'gamma', 2, 1, 3), (-1, 'shared', 3, 1, 1)) v(rule, line, i, w, whole)"""
sqlviews.VIEWS["aunits"] = "select provider, rule, product, bucket, period, cast(round(amount * 10000) as hugeint) * 10000 as a from adetail"
sqlviews.VIEWS["aparts"] = """
select provider, rule, product, bucket, period, line, (base + case when place <= spare then 1 else 0 end) * sign(a) as units from (
  select *, row_number() over (partition by provider, rule, product, bucket, period order by lost desc, i) as place,
    abs(a) - sum(base) over (partition by provider, rule, product, bucket, period) as spare
  from (select *, abs(a) * w // whole as base, (abs(a) * w) % whole as lost from aunits join wholeshares using (rule)))"""


@query("alloc_exact_lines", "select provider, line, period, sum(units)::bigint as units from aparts group by all")
def alloc_exact_lines(spark, sf_dir):
    # whole numbers of 38 digits: a month of some 10^11 is more units than a bigint holds
    parts = apportion.spread(_detail(spark, sf_dir), ALLOC)
    return parts.groupBy("provider", "line", "period").agg(apportion.to_units(F.sum("amount")).alias("units"))


@query("alloc_exact_balance", "select provider, rule, period, sum(a)::bigint as units, 0::bigint as off from aunits group by all")
def alloc_exact_balance(spark, sf_dir):
    """What all parts of a rule's money come to, and by how much that differs from the money."""
    detail = _detail(spark, sf_dir)
    both = apportion.spread(detail, ALLOC).select("provider", "rule", "period", "amount", F.lit(0).alias("own")).unionByName(
        detail.select("provider", "rule", "period", F.col("amount").cast("decimal(38,8)").alias("amount"), F.lit(1).alias("own")))
    units = lambda own: apportion.to_units(F.sum(F.when(F.col("own") == own, F.col("amount"))))
    return both.groupBy("provider", "rule", "period").agg(units(0).alias("units"), (units(0) - units(1)).cast("long").alias("off"))


@query("alloc_exact_prepaid", f"""
select provider, rule, product, shown as period, sum((size // months + case when k < size % months then 1 else 0 end) * sign(a))::bigint as units from (
  select *, abs(a) as size, unnest(range(months)) as k, strftime(cast(period || '-01' as date) + to_months(cast(k as int)), '%Y-%m') as shown from (
    select provider, {{RULE}} as rule, product, period, months, cast(sum(payable_e4) as hugeint) * 10000 as a
    from bill_d where provider = 'alicloud' and subscription = 'Subscription' group by all))
where shown between '{{FIRST}}' and '2027-06' group by all""".replace("{RULE}", RULE).replace("{FIRST}", FIRST))
def alloc_exact_prepaid(spark, sf_dir):
    rows = apportion.amortise(_daily(spark, sf_dir), ALL, ALLOC)
    return rows.withColumn("units", apportion.to_units(F.col("amount")).cast("long")).drop("amount")
