"""Service health queries over the derived ``spans`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from telespark.functions.timeaxis import Bucket, TimeRange
from telespark.operators import services as S
from telespark.plans import sqlviews, views
from telespark.plans.registry import query

DAY = TimeRange(views.BASE, views.BASE + 86_460_000)
NOW = TimeRange(views.BASE + 43_200_000, views.BASE + 86_460_000)     # "prev" is the half day before
ENTRY = "span_kind in ('Server', 'Consumer')"

FIGURES = """count(*) as requests, count(*) filter (status_code = 'Error') as errors, quantile_disc(duration_ns, 0.5) / 1000000.0::double as p50_ms,
  quantile_disc(duration_ns, 0.95) / 1000000.0::double as p95_ms, quantile_disc(duration_ns, 0.99) / 1000000.0::double as p99_ms, max(duration_ns) / 1000000.0::double as max_ms"""

SECS, NOW_FROM, NOW_TO = 43260.0, NOW.from_ms, NOW.to_ms


def _spans(spark, sf_dir):
    return views.spans(spark, sf_dir)


@query("service_stats", f"""
select service_name, 1 as is_total, null as bucket, {FIGURES} from spans where {ENTRY} and ts_ms >= $BASE and ts_ms < $DAY_END group by 1
union all
select service_name, 0, (ts_ms - $BASE) // 3600000, {FIGURES} from spans where {ENTRY} and ts_ms >= $BASE and ts_ms < $DAY_END group by 1, 3""")
def service_stats(spark, sf_dir):
    return S.service_stats(_spans(spark, sf_dir), DAY, Bucket.choose(DAY, "UTC", S.SPARK_BUCKETS))


@query("service_stats_one_zone", f"""
select service_name, {FIGURES} from spans where {ENTRY} and cluster in ('zone-1') and ts_ms >= $BASE and ts_ms < $DAY_END group by 1""")
def service_stats_one_zone(spark, sf_dir):
    out = S.service_stats(_spans(spark, sf_dir), DAY, Bucket.choose(DAY, "UTC", 30), {"cluster": ("zone-1",)})
    return out.where("is_total = 1").drop("is_total", "bucket")


sqlviews.VIEWS["windowed"] = f"""
select *, case when ts_ms >= {NOW_FROM} then 0 else 1 end as win,
  case when ts_ms >= {NOW_FROM} then ts_ms - {NOW_FROM} else ts_ms - {NOW_FROM - 43_260_000} end as rel
from spans where {ENTRY} and ts_ms >= {NOW_FROM - 43_260_000} and ts_ms < {NOW_TO}"""
sqlviews.VIEWS["svcstats"] = f"""
select c.service_name, c.requests, c.errors, c.errors / c.requests::double as error_rate, c.requests / {SECS} as rps, c.p50_ms, c.p95_ms, c.p99_ms, c.max_ms,
  p.requests as prev_requests, p.errors as prev_errors, p.errors / p.requests::double as prev_error_rate, p.requests / {SECS} as prev_rps, p.p95_ms as prev_p95_ms
from (select service_name, {FIGURES} from windowed where win = 0 group by 1) c
left join (select service_name, {FIGURES} from windowed where win = 1 group by 1) p on p.service_name = c.service_name"""

LINES = """select service_name, array_to_string(list(n order by slot), ',') as line from (
  select s.service_name, a.slot, count(w.trace_id) as n from (select distinct service_name from windowed where win = 0) s
  cross join (select unnest(range(24)) as slot) a left join windowed w on w.service_name = s.service_name and w.rel // 1800000 = a.slot and %s
  group by all) group by 1"""


@query("service_overview", f"""
select svcstats.*, a.line as spark_requests, b.line as spark_errors, c.line as spark_prev_requests from svcstats
join ({LINES % 'win = 0'}) a using (service_name) join ({LINES % "win = 0 and status_code = 'Error'"}) b using (service_name)
join ({LINES % 'win = 1'}) c using (service_name)""")
def service_overview(spark, sf_dir):
    out = S.service_overview(_spans(spark, sf_dir), NOW, "prev")
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in out.columns if c.startswith("spark_")})


@query("service_overview_overlapping", f"""
select c.service_name, c.n as requests, p.n as prev_requests from
 (select service_name, count(*) as n from spans where {ENTRY} and ts_ms >= $BASE + 86400000 - 129600000 and ts_ms < $DAY_END group by 1) c left join
 (select service_name, count(*) as n from spans where {ENTRY} and ts_ms >= $BASE - 129600000 and ts_ms < $DAY_END - 86400000 group by 1) p using (service_name)""")
def service_overview_overlapping(spark, sf_dir):
    rng = TimeRange(views.BASE - 43_200_000, views.BASE + 86_460_000)       # longer than the day it is compared with
    return S.service_overview(_spans(spark, sf_dir), rng, "day").select("service_name", "requests", "prev_requests")


@query("service_operations", f"""
select service_name, span_name, span_kind, requests, errors, errors / requests::double as error_rate, requests / 86460.0 as rps, p50_ms, p95_ms, p99_ms, max_ms
from (select *, row_number() over (partition by service_name order by requests desc, span_name, span_kind) as rn
  from (select service_name, span_name, span_kind, {FIGURES} from spans where span_kind in ('Client', 'Producer') and ts_ms >= $BASE and ts_ms < $DAY_END group by 1, 2, 3))
where rn <= 9""")
def service_operations(spark, sf_dir):
    return S.service_operations(_spans(spark, sf_dir), DAY, "client", per_service=9)


def _ops_view(per_service: int) -> str:
    side = f"""select * from (select *, row_number() over (partition by service_name order by requests desc, span_name, span_kind) as rn
      from (select service_name, span_name, span_kind, {FIGURES} from windowed where win = %d group by 1, 2, 3)) where rn <= {per_service}"""
    return f"""
select service_name, span_name, span_kind, coalesce(c.requests, 0) as requests, coalesce(c.errors, 0) as errors,
  case when c.requests > 0 then c.errors / c.requests::double else 0 end as error_rate, coalesce(c.requests, 0) / {SECS} as rps,
  coalesce(c.p50_ms, 0) as p50_ms, coalesce(c.p95_ms, 0) as p95_ms, coalesce(c.p99_ms, 0) as p99_ms, coalesce(c.max_ms, 0) as max_ms,
  p.requests as prev_requests, p.errors as prev_errors, p.errors / p.requests::double as prev_error_rate, p.requests / {SECS} as prev_rps,
  p.p50_ms as prev_p50_ms, p.p95_ms as prev_p95_ms, p.p99_ms as prev_p99_ms,
  case when c.requests is null then 'gone' when p.requests is null then 'new' end as status, coalesce(n, 0) >= {per_service} as truncated
from ({side % 0}) c full join ({side % 1}) p using (service_name, span_name, span_kind)
left join (select service_name, count(*) as n from ({side % 0}) group by 1) k using (service_name)
where c.requests is not null or coalesce(n, 0) < {per_service}"""


sqlviews.VIEWS["ops"] = _ops_view(200)
sqlviews.VIEWS["ops_capped"] = _ops_view(30)


def _ops(spark, sf_dir, per_service=200):
    return S.compare_operations(_spans(spark, sf_dir), NOW, "prev", per_service=per_service)


@query("compare_operations", "select * from ops")
def compare_operations(spark, sf_dir):
    return _ops(spark, sf_dir)


@query("compare_operations_capped", "select * from ops_capped")
def compare_operations_capped(spark, sf_dir):
    return _ops(spark, sf_dir, 30)


@query("operations_by_p95_change", """
select service_name, span_name, span_kind, round(case when requests >= 100 and prev_requests >= 100 then greatest(p95_ms - prev_p95_ms, 0) * requests else 0 end, 3) as p95_change,
  coalesce(errors - prev_errors, 0) as errors_change, round((requests - prev_requests) / prev_requests::double * 100, 1) as requests_change_pct,
  round(p95_ms / prev_p95_ms, 2) as p95_ratio from ops""")
def operations_by_p95_change(spark, sf_dir):
    out = S.shape_operations(_ops(spark, sf_dir), "p95_change")
    return out.select("service_name", "span_name", "span_kind", F.round("p95_change", 3).alias("p95_change"), "errors_change",
                      "requests_change_pct", F.when(F.col("status") == "gone", 0.0).otherwise(F.col("p95_ratio")).alias("p95_ratio"))


@query("service_timeseries", f"""
with a as (select unnest(range(73)) as slot),
c as (select rel // 600000 as slot, {FIGURES} from windowed where win = 0 and service_name = 'svc-6' group by 1),
p as (select rel // 600000 as slot, {FIGURES} from windowed where win = 1 and service_name = 'svc-6' group by 1)
select {NOW_FROM} + a.slot * 600000 as t_ms, coalesce(c.requests, 0) as requests, coalesce(c.errors, 0) as errors, coalesce(c.p50_ms, 0) as p50_ms,
  coalesce(c.p95_ms, 0) as p95_ms, coalesce(c.p99_ms, 0) as p99_ms, p.requests as prev_requests, p.errors as prev_errors, p.p95_ms as prev_p95_ms
from a left join c on c.slot = a.slot left join p on p.slot = a.slot""")
def service_timeseries(spark, sf_dir):
    return S.service_timeseries(_spans(spark, sf_dir), NOW, "svc-6", compare="prev")


sqlviews.VIEWS["health"] = """
select *, case when error_rate >= 0.05 or r >= 3 then 'bad' when error_rate >= 0.01 or r >= 1.5 or started then 'warn' else 'ok' end as health,
  concat_ws(',', case when error_rate >= 0.01 then 'error_rate' end, case when r >= 1.5 then 'p95_ratio' end,
    case when started then 'started_erroring' end) as reasons
from (select *, case when requests >= 300 and prev_requests >= 300 and prev_p95_ms > 0 and p95_ms >= 200 then p95_ms / prev_p95_ms end as r,
  coalesce(prev_errors = 0 and errors > 0 and error_rate >= 0.002, false) as started from svcstats)"""


def _health(spark, sf_dir):
    return S.service_health(S.service_overview(_spans(spark, sf_dir), NOW, "prev"))


@query("service_health", "select service_name, health, reasons, requests, round(r, 2) as p95_ratio from health")
def service_health(spark, sf_dir):
    return _health(spark, sf_dir).select("service_name", "health", F.array_join("reasons", ",").alias("reasons"), "requests", "p95_ratio")


sqlviews.VIEWS["movers"] = """
select *, case mover when 'gone' then 0 when 'errors' then 1 when 'latency' then 2 when 'new' then 3 else 4 end + case when better then 10 else 0 end as mover_rank
from (select *, case mover when 'errors' then errors < prev_errors when 'latency' then p95_ms < prev_p95_ms else false end as better,
    case mover when 'new' then requests when 'gone' then prev_requests when 'errors' then abs(errors - prev_errors)
      when 'latency' then abs((p95_ms - prev_p95_ms) * requests) else abs(requests - prev_requests) end as score
  from (select *, case when prev_requests is null then case when requests >= 100 then 'new' end
      when requests = 0 then case when prev_requests >= 100 then 'gone' end
      when abs(errors - prev_errors) >= 5 and (error_rate >= 0.005 or prev_error_rate >= 0.005) then 'errors'
      when requests >= 100 and prev_requests >= 100 and abs(p95_ms - prev_p95_ms) >= 20 and (p95_ms / prev_p95_ms >= 1.3 or p95_ms / prev_p95_ms <= 1 / 1.3) then 'latency'
      when abs(requests - prev_requests) >= 100 and (requests / prev_requests::double >= 1.3 or requests / prev_requests::double <= 1 / 1.3) then 'traffic' end as mover
    from ops) where mover is not null)"""


@query("operation_movers", """
select service_name, span_name, span_kind, mover, better, mover_rank, round(score, 3) as score, place from (select *, row_number() over
  (partition by service_name order by mover_rank, score desc, span_name, span_kind) as place from movers) where place <= 6""")
def operation_movers(spark, sf_dir):
    return S.operation_movers(_ops(spark, sf_dir), top=6).select(
        "service_name", "span_name", "span_kind", "mover", "better", "mover_rank", F.round("score", 3).alias("score"), "place")


HOT = """select * from (select *, row_number() over (partition by service_name order by score desc, span_name, span_kind) as hr from movers
  where mover = 'latency' and not better and p95_ms / prev_p95_ms >= 2 and score >= greatest(10000, 43260000 * 0.02)) where hr = 1"""


@query("latency_hotspot", f"select service_name, span_name, span_kind, round(score, 3) as score from ({HOT})")
def latency_hotspot(spark, sf_dir):
    return S.latency_hotspot(_ops(spark, sf_dir), NOW.span_ms).select("service_name", "span_name", "span_kind", F.round("score", 3).alias("score"))


@query("main_contributor", f"""
with hot as ({HOT}), ranked as (select *, row_number() over (partition by service_name order by mover_rank, score desc, span_name, span_kind) as place from movers),
named as (select r.service_name, r.span_name, r.span_kind, r.requests, r.mover, r.place, 0 as p95 from ranked r left join hot h on h.service_name = r.service_name
  where r.place <= 4 and case when h.service_name is null then r.place = 1 else r.span_name <> h.span_name and not r.better and r.mover in ('gone', 'errors', 'latency') end),
slow as (select service_name, span_name, span_kind, requests, 'slowest', 1000, p95_ms from ops where requests >= 30 and service_name not in (select service_name from hot))
select service_name, span_name, span_kind, requests, mover from (select *, row_number() over (partition by service_name order by place, p95 desc, span_name, span_kind) as rn
  from (select * from named union all select * from slow)) where rn = 1""")
def main_contributor(spark, sf_dir):
    return S.main_contributor(_ops(spark, sf_dir), NOW.span_ms)


@query("service_health_with_hotspots", f"""
select h.service_name, case when x.service_name is not null and health = 'ok' then 'warn' else health end as health,
  reasons || case when x.service_name is null then '' when reasons = '' then 'latency_hotspot' else ',latency_hotspot' end as reasons
from health h left join ({HOT}) x on x.service_name = h.service_name""")
def service_health_with_hotspots(spark, sf_dir):
    out = S.with_warning(_health(spark, sf_dir), S.latency_hotspot(_ops(spark, sf_dir), NOW.span_ms))
    return out.select("service_name", "health", F.array_join("reasons", ",").alias("reasons"))


@query("site_overview", f"""
select sum(requests) as requests, sum(requests) / {SECS} as rps, sum(errors) / sum(requests)::double as error_rate,
  round((sum(requests) / {SECS}) / (sum(prev_requests) / {SECS}) - 1, 9) as rps_change,
  round((sum(errors) / sum(requests)::double) / (sum(prev_errors) / sum(prev_requests)::double) - 1, 9) as error_rate_change,
  count(*) filter (health <> 'ok') as unhealthy, count(*) as services from health""")
def site_overview(spark, sf_dir):
    out = S.site_overview(_health(spark, sf_dir), NOW, "prev").drop("restarts")
    return out.withColumns({c: F.round(c, 9) for c in ("rps_change", "error_rate_change")})


@query("site_trend", """
select cast(slot as int) as slot, (select count(*) from windowed where win = 0 and rel // 1800000 = slot) as requests,
  (select count(*) from windowed where win = 0 and rel // 1800000 = slot and status_code = 'Error') as errors,
  (select count(*) from windowed where win = 1 and rel // 1800000 = slot) as prev_requests from (select unnest(range(24)) as slot)""")
def site_trend(spark, sf_dir):
    return S.site_trend(S.service_overview(_spans(spark, sf_dir), NOW, "prev"))
