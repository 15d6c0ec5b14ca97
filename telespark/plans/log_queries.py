"""Log queries over the derived ``app_log`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from telespark.functions.timeaxis import TimeRange
from telespark.operators import logs as L
from telespark.plans import views
from telespark.plans.registry import query
from telespark.streaming.tail import prime, tail_logs

MONTH = TimeRange(views.BASE, views.BASE + 31 * 86_400_000)
PARIS_ORIGIN = views.BASE - 3_600_000      # local midnight of the range start, Europe/Paris

RANGE = "ts_ms >= $BASE and ts_ms < $MONTH_END"


def _logs(spark, sf_dir):
    return views.app_log(spark, sf_dir)


@query("log_search_page", f"""
select ts_ms, level, trace_id, span_id, thread, logger, substr(message, 1, 200) as message, length(message) as message_len,
       file, host, service_name, namespace, pod, cluster
from app_log where {RANGE} and level in ('ERROR', 'WARN') order by ts_us desc, level desc, trace_id desc limit 200 offset 50""")
def log_search_page(spark, sf_dir):
    f = L.LogFilter(MONTH, levels=("error", "warn"))
    return L.search_logs(_logs(spark, sf_dir), f, limit=200, offset=50, cap=200)


@query("log_search_ascending", f"""
select ts_ms, level, trace_id, span_id, thread, logger, message, length(message) as message_len, file, host,
       service_name, namespace, pod, cluster
from app_log where {RANGE} and contains(lower(logger), 'app.p') and contains(lower(thread), 'worker') and host = 'host-3'
order by ts_us, level, trace_id limit 100""")
def log_search_ascending(spark, sf_dir):
    f = L.LogFilter(MONTH, logger="APP.P", thread="worker", host="host-3")
    return L.search_logs(_logs(spark, sf_dir), f, order="asc", limit=100)


@query("log_search_with_total", f"""
select ts_ms, trace_id, (select count(*) from app_log where {RANGE} and service_name in ('svc-1', 'svc-2')) as total
from app_log where {RANGE} and service_name in ('svc-1', 'svc-2') order by ts_us desc, level desc, trace_id desc limit 20""")
def log_search_with_total(spark, sf_dir):
    f = L.LogFilter(MONTH, dims={"service_name": ("svc-1", "svc-2")})
    return L.search_with_total(_logs(spark, sf_dir), f, limit=20).select("ts_ms", "trace_id", "total")


@query("log_count_levels", f"select count(*) as count from app_log where {RANGE} and level in ('INFO')")
def log_count_levels(spark, sf_dir):
    return L.count_logs(_logs(spark, sf_dir), L.LogFilter(MONTH, levels=("INFO",)))


@query("keyword_boolean", f"""
select service_name, level, count(*) as count from app_log where {RANGE}
 and (contains(lower(message), 'click') or contains(lower(message), 'view')) and contains(lower(message), '"k"')
 and not contains(lower(message), 'user=1') and not (contains(lower(message), 'k": 5') or contains(lower(message), 'k": 7'))
group by all""")
def keyword_boolean(spark, sf_dir):
    f = L.LogFilter(MONTH, q=r"""(Click OR view) "\"k\"" -user=1 NOT ("k\": 5" OR "k\": 7")""")
    return f.apply(_logs(spark, sf_dir)).groupBy("service_name", "level").agg(F.count("*").alias("count"))


TOKEN = "(^|[^a-z0-9\u0080-\U0010ffff])%s($|[^a-z0-9\u0080-\U0010ffff])"


@query("keyword_whole_token", f"""
select trace_id, ts_ms from app_log where {RANGE}
 and regexp_matches(lower(message), '{TOKEN % "rq0000000000000042"}')""")
def keyword_whole_token(spark, sf_dir):
    f = L.LogFilter(MONTH, q="RQ0000000000000042")
    return f.apply(_logs(spark, sf_dir)).select("trace_id", F.unix_millis("timestamp").alias("ts_ms"))


@query("keyword_token_in_term", f"""
select trace_id, ts_ms from app_log where {RANGE} and contains(lower(message), 'req=rq0000000000000042')
 and regexp_matches(lower(message), '{TOKEN % "rq0000000000000042"}')""")
def keyword_token_in_term(spark, sf_dir):
    f = L.LogFilter(MONTH, q="req=RQ0000000000000042")
    return f.apply(_logs(spark, sf_dir)).select("trace_id", F.unix_millis("timestamp").alias("ts_ms"))


@query("keyword_digits", f"""
select 'unscoped' as mode, trace_id from app_log where {RANGE} and regexp_matches(lower(message), '{TOKEN % "20240077"}')
union all
select 'service', trace_id from app_log where {RANGE} and contains(lower(message), '2024007') and service_name in ('svc-1', 'svc-5')""")
def keyword_digits(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    whole = L.LogFilter(MONTH, q="20240077").apply(logs).select(F.lit("unscoped").alias("mode"), "trace_id")
    part = L.LogFilter(MONTH, q="2024007", dims={"service_name": ("svc-1", "svc-5")}).apply(logs)
    return whole.unionByName(part.select(F.lit("service").alias("mode"), "trace_id"))


@query("keyword_regex", f"""
select level, count(*) as count from app_log where {RANGE} and regexp_matches(message, 'user=1[0-9]+ req=rq0+[1-4]') group by all""")
def keyword_regex(spark, sf_dir):
    f = L.LogFilter(MONTH, q="user=1[0-9]+ req=rq0+[1-4]", regex=True)
    return f.apply(_logs(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("count"))


HISTOGRAM = f"""
with hits as (select (ts_ms - $ORIGIN) // 21600000 as bucket, level, count(*) as n from app_log
              where {RANGE} and contains(lower(message), 'e') group by all),
     axis as (select unnest(range(($BASE - $ORIGIN) // 21600000, ($MONTH_END - 1 - $ORIGIN) // 21600000 + 1)) as bucket)
select $ORIGIN + axis.bucket * 21600000 as t_ms, l.level,
  case l.level when 'FATAL' then 0 when 'ERROR' then 1 when 'WARN' then 2 when 'WARNING' then 3 when 'INFO' then 4 when 'DEBUG' then 5 else 6 end as level_rank,
  coalesce(n, 0) as count
from axis cross join (select distinct level from hits) l left join hits on hits.bucket = axis.bucket and hits.level = l.level"""


@query("log_histogram", HISTOGRAM, ORIGIN=PARIS_ORIGIN)
def log_histogram(spark, sf_dir):
    return L.log_histogram(_logs(spark, sf_dir), L.LogFilter(MONTH, q="e"), tz="Europe/Paris", max_buckets=124)


@query("log_histogram_total", f"select count(*) as total from app_log where {RANGE} and contains(lower(message), 'e')")
def log_histogram_total(spark, sf_dir):
    return L.histogram_total(L.log_histogram(_logs(spark, sf_dir), L.LogFilter(MONTH, q="e")))


FACETS = ("service_name", "level", "logger", "thread", "namespace", "pod", "host", "cluster")
FACETS_SQL = f"""
select field, value, count from (
  select *, row_number() over (partition by field order by count desc, value) as rk from (
    select field, value, count(*) as count from (
      {' union all '.join(f"select '{c}' as field, {c} as value from app_log where {RANGE}" for c in FACETS)}) group by all))
where rk <= 15"""


@query("log_facets", FACETS_SQL)
def log_facets(spark, sf_dir):
    return L.log_facets(_logs(spark, sf_dir), L.LogFilter(MONTH), FACETS, k=15)


@query("log_facets_approx", FACETS_SQL.replace("rk <= 15", "field in ('service_name', 'level', 'host')"))
def log_facets_approx(spark, sf_dir):
    return L.log_facets(_logs(spark, sf_dir), L.LogFilter(MONTH), ("service_name", "level", "host"), k=40, exact=False)


@query("log_cross_filter_facets", """
select 'level' as field, level as value, count(*) as count,
  case level when 'ERROR' then 1 when 'WARN' then 2 when 'INFO' then 4 when 'DEBUG' then 5 else 6 end as rank
from app_log where service_name = 'svc-3' group by all
union all select 'service_name', service_name, count(*), 0 from app_log where level in ('ERROR', 'WARN') group by all
union all select 'pod', pod, count(*), 0 from app_log where level in ('ERROR', 'WARN') and service_name = 'svc-3' group by all""")
def log_cross_filter_facets(spark, sf_dir):
    return L.cross_filter_facets(_logs(spark, sf_dir), {
        "level": F.col("level").isin("ERROR", "WARN"), "service_name": F.col("service_name") == "svc-3", "pod": F.lit(True)})


@query("log_context", """
select * from (select 'before' as side, ts_ms, trace_id, level from app_log where host = 'host-3' and file = '/var/log/app-1.log'
   and ts_ms <= $AT and ts_ms >= $AT - 3600000 order by ts_us desc, level desc, trace_id desc limit 5)
union all
select * from (select 'after', ts_ms, trace_id, level from app_log where host = 'host-3' and file = '/var/log/app-1.log'
   and ts_ms > $AT and ts_ms < $AT + 3600000 order by ts_us, level, trace_id limit 5)""", AT=1_706_338_560_771)
def log_context(spark, sf_dir):
    rows = L.log_context(_logs(spark, sf_dir), "host-3", "/var/log/app-1.log", 1_706_338_560_771, n=5)
    return rows.select("side", "ts_ms", "trace_id", "level")


@query("log_context_batch", """
with a as (select trace_id as anchor_id, host, file, ts_ms as anchor_ms from app_log where level = 'ERROR'),
p as (select a.anchor_id, a.host, a.file, a.anchor_ms, l.ts_ms, l.level, l.trace_id, l.message,
        case when l.ts_ms <= a.anchor_ms then 'before' else 'after' end as side,
        row_number() over (partition by a.anchor_id, a.file, l.ts_ms <= a.anchor_ms order by
          case when l.ts_ms <= a.anchor_ms then -l.ts_us else l.ts_us end,
          case when l.ts_ms <= a.anchor_ms then l.level end desc, case when l.ts_ms > a.anchor_ms then l.level end,
          case when l.ts_ms <= a.anchor_ms then l.trace_id end desc, case when l.ts_ms > a.anchor_ms then l.trace_id end) as distance
      from a join app_log l on l.host = a.host and l.file = a.file
       and l.ts_ms >= a.anchor_ms - 3600000 and l.ts_ms < a.anchor_ms + 3600000)
select anchor_id, host, file, anchor_ms, ts_ms, level, trace_id, message, side, distance from p where distance <= 2""")
def log_context_batch(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    anchors = logs.where("level = 'ERROR'").select(F.col("trace_id").alias("anchor_id"), "host", "file",
                                                   F.unix_millis("timestamp").alias("ts_ms"))
    return L.log_context_batch(logs, anchors, n=2).drop("span_id")


@query("logs_for_trace", """
with x as (select trace_id, min(ts_ms) as a, max((ts_ms * 1000 + duration_ns // 1000) // 1000) as b from spans group by 1)
select l.trace_id, l.ts_ms, l.level, l.message from app_log l join x on x.trace_id = l.trace_id
where l.ts_ms >= greatest(a - 3600000, 0) and l.ts_ms < b + 3600000""")
def logs_for_trace(spark, sf_dir):
    rows = L.logs_for_trace(_logs(spark, sf_dir), views.spans(spark, sf_dir))
    return rows.select("trace_id", F.unix_millis("timestamp").alias("ts_ms"), "level", "message")


@query("log_shape_rows", f"""
select ts_ms, strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') as second, length(message) as message_len,
  case when length(message) > 80 then substr(message, 1, 80) || '… [' || cast(least(length(message), 16384) as varchar) || ' characters, cut]' else message end as message,
  trace_id, (case when cluster = '' then 0 else 1 end) + (case when span_id = '' then 0 else 1 end) + 9 as n_fields
from app_log where {RANGE} and service_name = 'svc-7'""")
def log_shape_rows(spark, sf_dir):
    f = L.LogFilter(MONTH, dims={"service_name": ("svc-7",)})
    rows = L.shape_log_row(L.log_columns(f.apply(_logs(spark, sf_dir)), L.MESSAGE_CAP), max_chars=80)
    return rows.select("ts_ms", F.substring("time", 1, 19).alias("second"), "message_len", "message",
                       F.col("fields")["trace_id"].alias("trace_id"), F.size("fields").alias("n_fields"))


@query("log_export", f"""
select strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') || '.' || lpad(cast(ts_ms % 1000 as varchar), 3, '0') as time,
  level, trace_id, message, file, host from app_log
where {RANGE} and level in ('ERROR') order by ts_us desc, level desc, trace_id desc limit 1000""")
def log_export(spark, sf_dir):
    rows = L.export_logs(_logs(spark, sf_dir), L.LogFilter(MONTH, levels=("ERROR",)), limit=1000)
    return rows.select("time", "level", "trace_id", "message", "file", "host")


@query("export_formula_guard", """
select doc_id, case when regexp_matches(text, '^[=+@\\t\\r-]') then '''' || text else text end as text,
  case when regexp_matches(substr(text, 2), '^[=+@\\t\\r-]') then '''' || substr(text, 2) else substr(text, 2) end as rest,
  -doc_id as negative from documents""")
def export_formula_guard(spark, sf_dir):
    from telespark.sources.export import guard_formula_cells
    docs = views.table(spark, sf_dir, "documents")
    return guard_formula_cells(docs.select("doc_id", "text", F.expr("substr(text, 2)").alias("rest"), (-F.col("doc_id")).alias("negative")))


@query("log_tail_once_each", f"""
select count(*) as lines, count(distinct trace_id) as traces, min(ts_ms) as first_ms, max(ts_ms) as last_ms from (
  select distinct ts_us, ts_ms, host, file, thread, logger, message, trace_id from app_log where ts_ms >= $FROM - 60000 and level in ('ERROR', 'WARN'))""",
       FROM=views.BASE + 432_000_000)
def log_tail_once_each(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    twice = logs.unionByName(logs.where("level = 'ERROR'"))            # lines delivered again
    rows = tail_logs(twice, L.LogFilter(MONTH, levels=("ERROR", "WARN")), cursor_ms=views.BASE + 432_000_000)
    ms = F.unix_millis("timestamp")
    return rows.agg(F.count("*").alias("lines"), F.count_distinct("trace_id").alias("traces"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


@query("log_tail_first_screen", f"select ts_ms, trace_id, level from app_log where {RANGE} order by ts_us desc, level desc, trace_id desc limit 200")
def log_tail_first_screen(spark, sf_dir):
    return prime(_logs(spark, sf_dir), L.LogFilter(MONTH)).select("ts_ms", "trace_id", "level")
