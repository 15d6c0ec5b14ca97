"""Metric queries over the derived ``metric`` points."""

from __future__ import annotations

from pyspark.sql import functions as F

from telespark.functions.attrs import AttrFilter
from telespark.functions.timeaxis import Bucket, TimeRange
from telespark.operators import dashboards as P
from telespark.operators import metrics as M
from telespark.plans import sqlviews, views
from telespark.plans.registry import query

MONTH = TimeRange(views.BASE, views.BASE + 31 * 86_400_000)
SIX = Bucket.choose(MONTH, "UTC", 124)           # six-hour buckets
W = SIX.width_ms
BUCKET = f"(ts_ms - $BASE) // {W}"
RANGE = "ts_ms >= $BASE and ts_ms < $MONTH_END"


def _points(spark, sf_dir):
    return views.otel_metric(spark, sf_dir)


def _f(metric, **kw):
    return M.MetricFilter(MONTH, metric, **kw)


def _flat(df):
    """Keys as text, so that rows compare across engines."""
    return df.withColumn("keys", F.array_join("keys", "|"))


@query("metric_catalog", """
select metric_name, metric_type, metric_unit, min('about ' || route) as description, min(temporality) as temporality,
  array_to_string(list_sort(list_distinct(list(service_name))), ',') as services, bool_or(route in ('click', 'signup')) as is_monotonic, count(*) as points
from metric where ts_ms >= $END - 21600000 and ts_ms < $END group by all""", END=views.BASE + 30 * 86_400_000)
def metric_catalog(spark, sf_dir):
    out = M.metric_catalog(_points(spark, sf_dir), TimeRange(views.BASE, views.BASE + 30 * 86_400_000))
    return out.withColumn("services", F.array_join("services", ","))


@query("metric_label_keys", f"""
select name, count(*) as count from (select unnest(['http.route', 'code']) as name from metric where {RANGE} and metric_name = 'requests') group by 1""")
def metric_label_keys(spark, sf_dir):
    return M.label_keys(_points(spark, sf_dir), _f("requests"))


@query("metric_label_values", f"""
select pod_name as name, count(*) as count from metric where {RANGE} and metric_name = 'latency' and code = '500' group by 1""")
def metric_label_values(spark, sf_dir):
    f = _f("latency", attrs=(AttrFilter.parse("code=500"),))
    return M.label_values(_points(spark, sf_dir), f, M.POD, "resource_attributes")


GAUGE = f"""select {BUCKET} as bucket, service_name || '|' || pod_name as keys, %s as v from metric
where {RANGE} and metric_name = 'queue.size' group by all"""
GAUGE_BY = ("service_name", "res:" + M.POD)


@query("metric_series_avg", GAUGE % "round(avg(value), 6)")
def metric_series_avg(spark, sf_dir):
    return _flat(M.series(_points(spark, sf_dir), _f("queue.size"), "avg", by=GAUGE_BY, bucket=SIX)).withColumn("v", F.round("v", 6))


@query("metric_series_max", GAUGE % "max(value)")
def metric_series_max(spark, sf_dir):
    return _flat(M.series(_points(spark, sf_dir), _f("queue.size"), "max", by=GAUGE_BY, bucket=SIX))


@query("metric_series_min_sum_count", f"""
select {BUCKET} as bucket, min(value) as lo, sum(value) as total, count(*) as n from metric where {RANGE} and metric_name = 'queue.size' group by all""")
def metric_series_min_sum_count(spark, sf_dir):
    pts = _points(spark, sf_dir)
    parts = {a: M.series(pts, _f("queue.size"), a, bucket=SIX) for a in ("min", "sum", "count")}
    out = parts["min"].select("bucket", F.col("v").alias("lo"))
    out = out.join(parts["sum"].select("bucket", F.col("v").alias("total")), "bucket")
    return out.join(parts["count"].select("bucket", F.col("v").alias("n")), "bucket")


@query("metric_series_last", GAUGE % "arg_max(value, ts_us)")
def metric_series_last(spark, sf_dir):
    return _flat(M.series(_points(spark, sf_dir), _f("queue.size"), "last", by=GAUGE_BY, bucket=SIX))


# one row per series and bucket, with its predecessor
sqlviews.VIEWS["steps"] = f"""
select *, lag(cur) over w as prev, lag(t) over w as prev_t, lag(cur_n) over w as prev_n from (
  select (ts_ms - {views.BASE}) // {W} as bucket, metric_name, service_name, pod_name, route, code, temporality,
    arg_max(case metric_name when 'latency' then sum else value end, ts_us) as cur, arg_max(cast(count as double), ts_us) as cur_n,
    sum(case metric_name when 'latency' then sum else value end) as dsum, max(ts_ms) as t
  from metric where ts_ms >= {views.BASE} and ts_ms < {MONTH.to_ms} group by all)
window w as (partition by metric_name, service_name, pod_name, route, code order by bucket)"""
GROWTH = """case when temporality = 'Cumulative' then case when prev_t is not null then case when cur >= prev then cur - prev else cur end end else dsum end"""
GROWTH_N = "case when prev_t is not null then case when cur_n >= prev_n then cur_n - prev_n else cur_n end end"
RATE = f"""case when temporality = 'Cumulative' then case when t > prev_t then ({GROWTH}) * 1000 / (t - prev_t) end else dsum / {W / 1000} end"""


@query("metric_increase", f"select bucket, service_name || '|' || route as keys, sum({GROWTH}) as v from steps where metric_name = 'requests' group by all",)
def metric_increase(spark, sf_dir):
    return _flat(M.series(_points(spark, sf_dir), _f("requests"), "increase", by=("service_name", "http.route"), bucket=SIX)).withColumn(
        "keys", F.replace("keys", F.lit("/"), F.lit("")))


@query("metric_increase_delta", f"select bucket, service_name as keys, sum({GROWTH}) as v from steps where metric_name = 'bytes' group by all")
def metric_increase_delta(spark, sf_dir):
    return _flat(M.series(_points(spark, sf_dir), _f("bytes"), "increase", by=("service_name",), bucket=SIX))


@query("metric_rate", f"select bucket, code as keys, round(sum({RATE}), 6) as v from steps where metric_name = 'requests' group by all")
def metric_rate(spark, sf_dir):
    out = M.series(_points(spark, sf_dir), _f("requests"), "rate", by=("code",), bucket=SIX)
    return _flat(out).withColumn("v", F.round("v", 6))


@query("metric_rate_delta", f"select bucket, pod_name as keys, round(sum({RATE}), 6) as v from steps where metric_name = 'bytes' group by all")
def metric_rate_delta(spark, sf_dir):
    out = M.series(_points(spark, sf_dir), _f("bytes"), "rate", by=("res:" + M.POD,), bucket=SIX)
    return _flat(out).withColumn("v", F.round("v", 6))


@query("metric_mean", f"""
select bucket, service_name as keys, round(sum({GROWTH}) / nullif(sum({GROWTH_N}), 0), 6) as v from steps where metric_name = 'latency' group by all""")
def metric_mean(spark, sf_dir):
    out = M.series(_points(spark, sf_dir), _f("latency"), "mean", "sum", by=("service_name",), bucket=SIX)
    return _flat(out).withColumn("v", F.round("v", 6))


sqlviews.VIEWS["hist"] = f"""
select bucket, service_name, sum(a) as a, sum(b) as b, sum(c) as c, sum(d) as d from (
  select bucket, service_name, {', '.join(f"case when p is null then 0 when cur[{i}] >= p[{i}] then cur[{i}] - p[{i}] else cur[{i}] end as {n}" for i, n in enumerate('abcd', 1))}
  from (select *, lag(cur) over (partition by service_name, pod_name, code order by bucket) as p from (
    select (ts_ms - {views.BASE}) // {W} as bucket, service_name, pod_name, code, arg_max(bucket_counts, ts_us) as cur
    from metric where metric_name = 'latency' and ts_ms >= {views.BASE} and ts_ms < {MONTH.to_ms} group by all))) group by all"""


def _hist(spark, sf_dir):
    return M.histogram_increase(_points(spark, sf_dir), _f("latency"), by=("service_name",), bucket=SIX)


@query("metric_histogram_increase", "select bucket, service_name as keys, concat_ws(',', a, b, c, d) as counts from hist")
def metric_histogram_increase(spark, sf_dir):
    return _flat(_hist(spark, sf_dir)).select("bucket", "keys", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


def _quantile_sql(q):
    t = f"((a + b + c + d) * {q}::double)"
    return f"""case when a + b + c + d <= 0 then null
      when a >= {t} then case when a <= 0 then 10 else 10 * {t} / a end
      when a + b >= {t} then 10 + 40 * ({t} - a) / b
      when a + b + c >= {t} then 50 + 50 * ({t} - a - b) / c else 100 end"""


sqlviews.VIEWS["quant"] = "\nunion all\n".join(
    f"select bucket, service_name, '{n}' as q, {_quantile_sql(q)} as v from hist" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


@query("metric_histogram_quantile", "select bucket, service_name || '|' || q as keys, round(v, 6) as v from quant")
def metric_histogram_quantile(spark, sf_dir):
    out = M.histogram_quantile(_hist(spark, sf_dir), (0.5, 0.95, 0.99))
    return _flat(out).withColumn("v", F.round("v", 6))


TOTALS = f"""select pod_name || '|' || route as keys, sum(abs(v)) as weight from (
  select bucket, pod_name, route, sum({GROWTH}) as v from steps where metric_name = 'requests' group by all) group by all"""


def _increase_by_pod(spark, sf_dir):
    out = M.series(_points(spark, sf_dir), _f("requests"), "increase", by=("res:" + M.POD, "http.route"), bucket=SIX)
    return out.withColumn("keys", F.transform("keys", lambda k: F.replace(k, F.lit("/"), F.lit(""))))


@query("metric_top_series", f"""
with t as ({TOTALS}), r as (select *, row_number() over (order by weight desc, keys) as rank from t)
select s.bucket, r.keys, sum({GROWTH}) as v, r.rank, true as truncated from steps s join r on r.keys = s.pod_name || '|' || s.route
where metric_name = 'requests' and r.rank <= 7 group by all""")
def metric_top_series(spark, sf_dir):
    return _flat(M.top_series(_increase_by_pod(spark, sf_dir), 7))


@query("metric_align_series", f"""
with axis as (select unnest(range({SIX.count(MONTH)})) as bucket),
c as (select bucket, service_name, sum({GROWTH}) as v from steps where metric_name = 'requests' group by all)
select 'service_name=' || k.service_name as name, array_to_string(list(coalesce(cast(cast(v as bigint) as varchar), '-') order by axis.bucket), ',') as line,
  min(v) as min, max(v) as max, round(avg(v), 6) as avg, arg_max(v, case when v is not null then axis.bucket end) as last
from axis cross join (select distinct service_name from c) k left join c on c.bucket = axis.bucket and c.service_name = k.service_name group by 1""")
def metric_align_series(spark, sf_dir):
    pts = M.series(_points(spark, sf_dir), _f("requests"), "increase", by=("service_name",), bucket=SIX)
    out = M.align_series(pts, MONTH, SIX, ("service_name",), "requests", limit=20)
    line = F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("bigint").cast("string"), F.lit("-"))), ",")
    return out.select("name", line.alias("line"), "min", "max", F.round("avg", 6).alias("avg"), "last")


@query("metric_fold_other", f"""
with t as ({TOTALS}), r as (select *, row_number() over (order by weight desc, keys) as rank from t)
select $BASE + bucket * {W} as t_ms, r.rank > 8 as other, case when r.rank <= 8 then r.keys end as keys, sum({GROWTH}) as v
from steps s join r on r.keys = s.pod_name || '|' || s.route where metric_name = 'requests' and bucket < {SIX.complete(MONTH)} group by all""")
def metric_fold_other(spark, sf_dir):
    return _flat(M.fold_other(_increase_by_pod(spark, sf_dir), MONTH, SIX))


RATE_AVG = f"""select code, avg(v) as a from (select bucket, code, sum({RATE}) as v from steps where metric_name = 'requests' group by all) group by 1"""


@query("metric_headline", f"""
select round((select sum(a) from ({RATE_AVG})), 6) as rate, round((select sum(a) filter (code = '500') / sum(a) from ({RATE_AVG})), 6) as error_rate,
  round((select max(a) from (select service_name, avg(v) as a from quant where q = 'p95' group by 1)), 6) as p95,
  round((select max(a) from (select service_name, avg(v) as a from quant where q = 'p99' group by 1)), 6) as p99""")
def metric_headline(spark, sf_dir):
    pts = _points(spark, sf_dir)
    rate = M.align_series(M.series(pts, _f("requests"), "rate", by=("code",), bucket=SIX), MONTH, SIX, ("code",))
    tail = M.align_series(M.histogram_quantile(_hist(spark, sf_dir), (0.95, 0.99)), MONTH, SIX, ("service_name", "quantile"))
    out = M.metric_headline(rate, tail)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("metric_top_table", f"""
with a as (select service_name, avg(v) as a from (select bucket, service_name, sum({RATE}) as v from steps where metric_name = 'bytes' group by all) group by 1)
select 'service_name=' || service_name as name, round(a, 6) as value, round(a / (select sum(a) from a), 6) as share from a""")
def metric_top_table(spark, sf_dir):
    pts = M.series(_points(spark, sf_dir), _f("bytes"), "rate", by=("service_name",), bucket=SIX)
    out = M.top_table(M.align_series(pts, MONTH, SIX, ("service_name",)))
    return out.select("name", F.round("value", 6).alias("value"), F.round("share", 6).alias("share"))


RESTARTS = f"""select ts_ms as t_ms, pod_name as pod, service_name from (select *, lag(x) over (partition by service_name, pod_name order by ts_us, x) as p
  from (select *, %s as x from metric where metric_name = '%s' and {RANGE})) where p > 0 and x < p"""
STARTS = f"""select min(ts_ms) as t_ms, pod_name as pod, service_name from metric where metric_name = '%s' and {RANGE}
  group by pod_name, service_name having min(ts_ms) > $BASE + 120000"""


@query("metric_counter_restarts", RESTARTS % ("value", "requests"))
def metric_counter_restarts(spark, sf_dir):
    return M.counter_restarts(_points(spark, sf_dir), _f("requests"), limit=None)


@query("metric_pod_starts", STARTS % "requests")
def metric_pod_starts(spark, sf_dir):
    return M.pod_starts(_points(spark, sf_dir), _f("requests"), limit=None)


@query("metric_events_histogram", f"select 'restart' as kind, * from ({RESTARTS % ('count', 'latency')}) union all select 'start', * from ({STARTS % 'latency'})")
def metric_events_histogram(spark, sf_dir):
    return M.metric_events(_points(spark, sf_dir), _f("latency"), limit=None)


@query("metric_exemplars", f"""
select ts_ms as t_ms, cast(cents as double) as value, lpad(cast(event_id as varchar), 32, '0') as trace_id, lpad(cast(event_id as varchar), 16, '0') as span_id, service_name
from metric where metric_name = 'latency' and {RANGE} order by value desc, t_ms desc, trace_id limit 100""")
def metric_exemplars(spark, sf_dir):
    return M.exemplars(_points(spark, sf_dir), _f("latency"), limit=100)


BOARD = {"traffic": {"rate": [("http.requests", "rate", "", "", "", ""), ("requests", "rate", "", "code", "", "")],
                     "latency": [("latency", "quantile", "", "", "", "0.5,0.95"), ("requests", "avg", "", "", "", "")]},
         "queue": {"size": [("queue.size", "last", "", "", "", "")], "gone": [("nothing", "avg", "", "", "", "")]}}


@query("dashboard_panels", f"""
select section, panel, variant, p.metric_name, agg, metric_type from (values ('traffic', 'rate', 1, 'requests', 'rate'),
  ('traffic', 'latency', 0, 'latency', 'quantile'), ('queue', 'size', 0, 'queue.size', 'last')) p(section, panel, variant, metric_name, agg)
join (select distinct metric_name, metric_type from metric where {RANGE}) c on c.metric_name = p.metric_name""")
def dashboard_panels(spark, sf_dir):
    catalog = _points(spark, sf_dir).where(MONTH.holds()).select("metric_name", "metric_type", "metric_unit").distinct()
    return P.resolve_dashboard(catalog, BOARD).select("section", "panel", "variant", "metric_name", "agg", "metric_type")


@query("dashboard_uncovered", f"select metric_name, count(*) as points from metric where {RANGE} and metric_name not in ('requests', 'latency', 'queue.size') group by 1")
def dashboard_uncovered(spark, sf_dir):
    catalog = _points(spark, sf_dir).where(MONTH.holds()).groupBy("metric_name").agg(F.count("*").alias("points"))
    return P.uncovered_metrics(catalog, BOARD)


# --- spikes of span-derived series, drilled back into spans ----------------------------------------

DAY = TimeRange(views.BASE, views.BASE + 86_460_000)
HALF_HOUR = Bucket.of_width(DAY, 1_800_000)
SPAN_CELLS = """select (ts_ms - $BASE) // 1800000 as bucket, service_name, http_status, avg(duration_ns / 1000000.0::double) as v from spans
  where ts_ms >= $BASE and ts_ms < $DAY_END group by all"""
BY = ("service_name", "http.response.status_code")


def _spikes(spark, sf_dir):
    spans = views.spans(spark, sf_dir).where(DAY.holds())
    status = F.col("span_attributes")["http.response.status_code"]
    cells = (spans.groupBy(HALF_HOUR.index().alias("bucket"), F.array("service_name", status).alias("keys"))
             .agg(F.round(F.avg(F.col("duration_ns") / 1_000_000), 3).alias("v")))
    return spans, P.spikes_from_series(cells.where("v >= 5300"), HALF_HOUR, BY, "ms", "avg")


SPIKES = f"select bucket || '|' || service_name || '|' || http_status as spike_id, bucket, service_name, http_status, round(v, 3) as v from ({SPAN_CELLS}) where round(v, 3) >= 5300"


@query("drill_spikes", f"select spike_id, service_name, $BASE + bucket * 1800000 as t_ms, http_status as attr, v as min_ms from ({SPIKES})")
def drill_spikes(spark, sf_dir):
    _, spikes = _spikes(spark, sf_dir)
    return spikes.select("spike_id", "service_name", "t_ms", F.col("attrs")[0]["value"].alias("attr"), "min_ms")


@query("drill_to_traces", f"""
with k as ({SPIKES}), d as (select spike_id, trace_id, max(duration_ns) as duration_ns, count(*) as spans from k join spans s
  on s.service_name = k.service_name and s.http_status = k.http_status and (s.ts_ms - $BASE) // 1800000 = k.bucket
  where s.ts_ms >= $BASE and s.ts_ms < $DAY_END and s.duration_ns >= cast(trunc(k.v * 1000000) as bigint) group by all)
select * from (select *, row_number() over (partition by spike_id order by duration_ns desc, trace_id) as place from d) where place <= 5""")
def drill_to_traces(spark, sf_dir):
    spans, spikes = _spikes(spark, sf_dir)
    return P.drill_to_traces(spans, spikes, HALF_HOUR, 5)


@query("drill_to_errors", f"""
select spike_id, s.span_name, s.http_status, count(*) as count from ({SPIKES}) k join spans s on s.service_name = k.service_name
  and (s.ts_ms - $BASE) // 1800000 = k.bucket where s.status_code = 'Error' and s.ts_ms >= $BASE and s.ts_ms < $DAY_END group by all""")
def drill_to_errors(spark, sf_dir):
    spans, spikes = _spikes(spark, sf_dir)
    return P.drill_to_errors(spans, spikes, HALF_HOUR)


LINE_CELLS = f"select {BUCKET} as bucket, service_name, namespace, count(*) as v from app_log where {RANGE} group by all"
LOUD = f"select bucket || '|' || service_name || '|' || namespace as spike_id, * from ({LINE_CELLS}) where v >= (select 1.5 * avg(v) from ({LINE_CELLS}))"


def _loud(spark, sf_dir):
    """Six-hour cells of a service and namespace with far more lines than usual."""
    logs = views.app_log(spark, sf_dir).where(MONTH.holds())
    cells = logs.groupBy(SIX.index().alias("bucket"), F.array("service_name", "namespace").alias("keys")).agg(F.count("*").alias("v"))
    return logs, cells.where(F.col("v") >= 1.5 * cells.agg(F.avg("v")).scalar())


@query("drill_to_logs", f"""
select spike_id, l.service_name, l.level, count(*) as lines, min(ts_ms) as first_ms from ({LOUD}) k join app_log l
  on l.service_name = k.service_name and l.namespace = k.namespace and {BUCKET} = k.bucket where {RANGE} group by all""")
def drill_to_logs(spark, sf_dir):
    logs, cells = _loud(spark, sf_dir)
    hit = P.drill_to_logs(logs, P.spikes_from_series(cells, SIX, ("service_name", "res:k8s.namespace.name")), SIX)
    return hit.groupBy("spike_id", "service_name", "level").agg(F.count("*").alias("lines"), F.min(F.unix_millis("timestamp")).alias("first_ms"))


@query("drill_to_logs_of_page", f"""
with c as (select {BUCKET} as bucket, namespace, sum(1) as v from app_log where {RANGE} and service_name = 'svc-3' group by all)
select c.bucket || '|' || c.namespace as spike_id, l.level, count(*) as lines from c join app_log l on l.service_name = 'svc-3' and l.namespace = c.namespace
  and {BUCKET} = c.bucket where {RANGE} and c.v >= (select 1.5 * avg(v) from c) group by all""")
def drill_to_logs_of_page(spark, sf_dir):
    """Series without a service, on the page of one: its lines only."""
    logs = views.app_log(spark, sf_dir).where(MONTH.holds())
    cells = logs.where("service_name = 'svc-3'").groupBy(SIX.index().alias("bucket"), F.array("namespace").alias("keys")).agg(F.count("*").alias("v"))
    loud = cells.where(F.col("v") >= 1.5 * cells.agg(F.avg("v")).scalar())
    hit = P.drill_to_logs(logs, P.spikes_from_series(loud, SIX, ("res:k8s.namespace.name",), service="svc-3"), SIX)
    return hit.groupBy("spike_id", "level").agg(F.count("*").alias("lines"))


@query("metric_chart_cells", f"""
with c as (select bucket, service_name as keys, sum({GROWTH}) as v from steps where metric_name = 'bytes' group by all)
select a.bucket, k.keys, c.v from (select unnest(range({SIX.count(MONTH)})) as bucket) a cross join (select distinct keys from c) k
left join c on c.bucket = a.bucket and c.keys = k.keys""")
def metric_chart_cells(spark, sf_dir):
    pts = M.series(_points(spark, sf_dir), _f("bytes"), "increase", by=("service_name",), bucket=SIX)
    return _flat(M.chart_cells(pts, MONTH, SIX))
