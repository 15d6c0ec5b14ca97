"""Queries that run as streams over the derived tables, and queries answered from stored states.

Rows arrive in slices of time, a part of them one slice late; the stream is stopped after half of them and goes on from
its checkpoint. What a stream gives is final, so the twins stop at its last watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.functions.lineage import forget_at_exit, written
from telespark.functions.timeaxis import Bucket, TimeRange
from telespark.operators import logs as L
from telespark.operators import metrics as M
from telespark.operators import rollups, toplists
from telespark.operators.traces import SpanFilter
from telespark.plans import views
from telespark.plans.registry import query
from telespark.streaming import rolling, tail

HOUR, DAY_MS = 3_600_000, 86_400_000
MONTH = TimeRange(views.BASE, views.BASE + 31 * DAY_MS)
SIX_HOURS = Bucket(6 * HOUR, views.BASE)
HOURS = Bucket(HOUR, views.BASE)
ONE_DAY = TimeRange(views.BASE, views.BASE + DAY_MS)
LATER_HALF = TimeRange(views.BASE + DAY_MS // 2, views.BASE + DAY_MS)
SLICES = 4
EXACT = 4096            # durations that a sketch of these queries holds exactly


def streamed(rows: DataFrame, slice_ms: int, late_ms: int, make, rocks: bool = False) -> DataFrame:
    """Results of ``make(stream)`` over ``rows``, which arrive slice by slice; some of a slice's last ones come with the next."""
    spark, path = rows.sparkSession, written(rows.where("false"), "arriving")
    base = written(rows.where("false").select("timestamp"), "stream")
    out, state = base + "-out", base + "-state"
    at = F.unix_millis("timestamp") - F.lit(views.BASE)
    own = F.greatest(F.lit(0), F.floor(at / slice_ms))
    held_back = ((own + 1) * slice_ms - at < late_ms // 2) & (F.pmod(F.xxhash64("timestamp"), F.lit(3)) == 0)
    slot = F.least(own + held_back.cast("int"), F.lit(SLICES - 1))
    for k in range(SLICES):
        rows.where(slot == k).write.mode("append").parquet(path)
        if k % 2:
            stream = tail.read_stream(spark, path, rows.schema, files_per_trigger=None)
            tail.drain(rolling.start(make(stream), out, state, once=True, rocks=rocks), 1200)
    for used in (out, state):
        forget_at_exit(spark, used)
    return spark.read.parquet(out)


LATE_RESTARTS = 6 * HOUR


@query("stream_counter_restarts", f"""
select ts_ms as t_ms, pod_name as pod, service_name from (select *, lag(value) over (partition by service_name, pod_name order by ts_us, value) as p
  from metric where metric_name = 'requests' and ts_ms >= $BASE and ts_ms < $MONTH_END)
where p > 0 and value < p and ts_us <= (select (max(ts_us) // 1000 - {LATE_RESTARTS}) * 1000 from metric where metric_name = 'requests')""")
def stream_counter_restarts(spark, sf_dir):
    f = M.MetricFilter(MONTH, "requests")
    points = views.otel_metric(spark, sf_dir).select("timestamp", "metric_name", "metric_type", "service_name", "resource_attributes", "value", "count")
    return streamed(points, 8 * DAY_MS, LATE_RESTARTS,
                    lambda points: rolling.counter_restarts(points, f, late=f"{LATE_RESTARTS} milliseconds"), rocks=True)


LEVELS = ("ERROR", "WARN", "INFO", "DEBUG")
LATE_LINES = 2 * HOUR


@query("stream_log_histogram", f"""
with line as (select ts_ms, level, (ts_ms - $BASE) // {SIX_HOURS.width_ms} as bucket from app_log where ts_ms >= $BASE and ts_ms < $MONTH_END),
closed as (select bucket, level, count(*) as count from line
  where $BASE + (bucket + 1) * {SIX_HOURS.width_ms} <= (select max(ts_us) // 1000 - {LATE_LINES} from app_log) group by all),
cell as (select unnest(range(0, (select max(bucket) + 1 from closed))) as bucket)
select $BASE + bucket * {SIX_HOURS.width_ms} as t_ms, level, case level when 'ERROR' then 1 when 'WARN' then 2 when 'INFO' then 4 when 'DEBUG' then 5 end as level_rank,
  coalesce(count, 0) as count from cell cross join (select unnest(['ERROR', 'WARN', 'INFO', 'DEBUG']) as level) left join closed using (bucket, level)""")
def stream_log_histogram(spark, sf_dir):
    return streamed(views.app_log(spark, sf_dir).select("timestamp", "level"), 8 * DAY_MS, LATE_LINES,
                    lambda lines: rolling.log_histogram(lines, L.LogFilter(MONTH), SIX_HOURS, LEVELS, late=f"{LATE_LINES} milliseconds"), rocks=True)


FIGURES = """count(*) as requests, count(*) filter (status_code = 'Error') as errors, quantile_disc(duration_ns, 0.5) / 1000000.0::double as p50_ms,
  quantile_disc(duration_ns, 0.95) / 1000000.0::double as p95_ms, quantile_disc(duration_ns, 0.99) / 1000000.0::double as p99_ms, max(duration_ns) / 1000000.0::double as max_ms"""
ENTRY = "span_kind in ('Server', 'Consumer')"


@query("stream_service_stats", f"""
with x as (select *, (ts_ms - $BASE) // {HOUR} as b from spans where {ENTRY}),
y as (select * from x where $BASE + (b + 1) * {HOUR} <= (select max(ts_ms) - {HOUR // 2} from x) and b between 0 and 23)
select service_name, 1 as is_total, null as bucket, {FIGURES} from y group by 1
union all select service_name, 0, b, {FIGURES} from y group by 1, 3""")
def stream_service_stats(spark, sf_dir):
    spans = views.spans(spark, sf_dir).select("timestamp", "service_name", "span_kind", "duration_ns", "status_code")
    states = streamed(spans, 6 * HOUR, HOUR // 2,
                      lambda spans: rolling.service_states(spans, HOURS, late=f"{HOUR // 2} milliseconds", k=EXACT))
    return rollups.stats(states, ONE_DAY, HOURS)


# --- from stored states ----------------------------------------------------------------------------

def _states(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(written(rollups.span_rollup(views.spans(spark, sf_dir), HOURS, k=EXACT), "span-states"))


@query("rollup_service_stats", f"""
select service_name, 1 as is_total, null as bucket, {FIGURES} from spans where {ENTRY} and ts_ms >= $BASE and ts_ms < $BASE + {DAY_MS} group by 1
union all select service_name, 0, (ts_ms - $BASE) // {HOUR}, {FIGURES} from spans where {ENTRY} and ts_ms >= $BASE and ts_ms < $BASE + {DAY_MS} group by 1, 3""")
def rollup_service_stats(spark, sf_dir):
    return rollups.stats(_states(spark, sf_dir), ONE_DAY, HOURS)


@query("rollup_operations", f"""
select service_name, span_name, span_kind, {FIGURES}, errors / requests::double as error_rate, sum(duration_ns) / 1000000.0::double as total_ms
from spans where ts_ms >= $BASE and ts_ms < $BASE + {DAY_MS} group by 1, 2, 3""")
def rollup_operations(spark, sf_dir):
    return rollups.operations(_states(spark, sf_dir), ONE_DAY, HOURS)


@query("rollup_compare_operations", f"""
with x as (select *, ts_ms >= $BASE + {DAY_MS // 2} as now from spans where ts_ms >= $BASE and ts_ms < $BASE + {DAY_MS}),
c as (select service_name, span_name, span_kind, {FIGURES} from x where now group by 1, 2, 3),
p as (select service_name, span_name, span_kind, {FIGURES} from x where not now group by 1, 2, 3)
select service_name, span_name, span_kind, case when p.requests is null then 'new' when c.requests is null then 'gone' else 'both' end as state,
  coalesce(c.requests, 0) as requests, coalesce(c.errors, 0) as errors, coalesce(p.requests, 0) as prev_requests, coalesce(p.errors, 0) as prev_errors,
  c.p50_ms, c.p95_ms, c.p99_ms, p.p50_ms as prev_p50_ms, p.p95_ms as prev_p95_ms, p.p99_ms as prev_p99_ms, c.max_ms, p.max_ms as prev_max_ms
from c full join p using (service_name, span_name, span_kind)""")
def rollup_compare_operations(spark, sf_dir):
    return rollups.compare(_states(spark, sf_dir), LATER_HALF, HOURS, "prev")


# --- top lists from states, newest rows by probing ---------------------------------------------------

DAYS = Bucket(DAY_MS, views.BASE)
FACETS = ("service_name", "level", "logger", "host")
WEEK = TimeRange(views.BASE + 2 * DAY_MS, views.BASE + 9 * DAY_MS)


@query("rollup_log_facets", f"""
select field, value, count from (
  select *, row_number() over (partition by field order by count desc, value) as rk from (
    select field, value, count(*) as count from ({' union all '.join(f"select '{c}' as field, {c} as value from app_log where ts_ms >= {WEEK.from_ms} and ts_ms < {WEEK.to_ms}" for c in FACETS)})
    group by all)) where rk <= 15""")
def rollup_log_facets(spark, sf_dir):
    states = spark.read.parquet(written(toplists.facet_states(views.app_log(spark, sf_dir), L.LogFilter(MONTH), FACETS, DAYS), "facet-states"))
    return toplists.facets(states, 15, WEEK, DAYS).drop("error")


@query("probe_newest_logs", """
select ts_ms, trace_id, level, host from app_log where ts_ms >= $BASE and ts_ms < $MONTH_END and level in ('ERROR', 'WARN')
order by ts_us desc, level desc, trace_id desc limit 300 offset 20""")
def probe_newest_logs(spark, sf_dir):
    f = L.LogFilter(MONTH, levels=("ERROR", "WARN"))
    return toplists.newest_logs(views.app_log(spark, sf_dir), f, 300, 20).select("ts_ms", "trace_id", "level", "host")


@query("probe_newest_traces", f"""
select trace_id, max(ts_ms) as ts_ms from spans where {ENTRY} and service_name = 'svc-3' and ts_ms >= $BASE and ts_ms < $DAY_END group by 1
order by ts_ms desc, trace_id limit 120""")
def probe_newest_traces(spark, sf_dir):
    f = SpanFilter(TimeRange(views.BASE, views.BASE + DAY_MS + 60_000), service="svc-3").entry_by_default()
    return toplists.newest_traces(views.spans(spark, sf_dir), f, 120)
