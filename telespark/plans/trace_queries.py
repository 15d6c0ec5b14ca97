"""Trace and database-call queries over the derived ``spans`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from telespark.functions.attrs import AttrFilter, flatten_attributes
from telespark.functions.timeaxis import TimeRange
from telespark.operators import dbcalls as D
from telespark.operators import traces as T
from telespark.operators import tree as R
from telespark.plans import sqlviews, views
from telespark.plans.registry import query

DAY = TimeRange(views.BASE, views.BASE + 86_460_000)
IN_DAY = "ts_ms >= $BASE and ts_ms < $DAY_END"
# the unscoped guard is lifted so that every query covers the whole table
OPEN = dict(range=DAY, unscoped_ms=None)

sqlviews.VIEWS["uniq"] = """
select * exclude (rn) from (select *, row_number() over (partition by trace_id, span_id
  order by ts_ms, duration_ns, service_name, span_name, status_code) as rn from spans) where rn = 1"""


def _spans(spark, sf_dir):
    return views.spans(spark, sf_dir)


@query("trace_candidates_time", f"""
select trace_id, max(ts_ms) as ts_ms from spans where {IN_DAY} and status_code = 'Error' group by 1
order by ts_ms desc, trace_id limit 50""")
def trace_candidates_time(spark, sf_dir):
    f = T.SpanFilter(error_only=True, **OPEN)
    return T.candidate_traces(_spans(spark, sf_dir), f, "time", 50).drop("rank_ns")


@query("trace_candidates_duration", f"""
select trace_id, rank_ns, ts_ms from (select trace_id, duration_ns as rank_ns, ts_ms, row_number() over
  (partition by trace_id order by duration_ns desc, ts_ms desc) as rn from spans
  where {IN_DAY} and span_kind in ('Server', 'Consumer') and http_status = '500' and cluster in ('zone-0', 'zone-2') and duration_ns >= 2000000000)
where rn = 1 order by rank_ns desc, ts_ms desc, trace_id limit 50""")
def trace_candidates_duration(spark, sf_dir):
    f = T.SpanFilter(attrs=(AttrFilter.parse("http.response.status_code=500"),), dims={"cluster": ("zone-0", "zone-2")},
                     min_duration_ns=2_000_000_000, **OPEN).entry_by_default()
    return T.candidate_traces(_spans(spark, sf_dir), f, "duration", 50)


SUMMARY = """
select trace_id, min(ts_ms) * 1000 as start_us, max(ts_ms * 1000000 + duration_ns) - min(ts_ms) * 1000000 as span_ns,
  count(*) as span_count, count(*) filter (status_code = 'Error') as error_count,
  case when count(*) filter (parent_span_id = '') = 0 then arg_min(duration_ns, (ts_ms, span_id)) else max(duration_ns) filter (parent_span_id = '') end as duration_ns,
  case when count(*) filter (parent_span_id = '') = 0 then arg_min(service_name, (ts_ms, span_id)) else arg_min(service_name, (ts_ms, span_id)) filter (parent_span_id = '') end as root_service,
  case when count(*) filter (parent_span_id = '') = 0 then arg_min(span_name, (ts_ms, span_id)) else arg_min(span_name, (ts_ms, span_id)) filter (parent_span_id = '') end as root_name,
  count(*) filter (parent_span_id = '') = 0 as root_missing, list_sort(list_distinct(list(service_name))) as services
from uniq"""


@query("trace_summaries", SUMMARY.replace("list_sort(list_distinct(list(service_name)))",
                                          "array_to_string(list_sort(list_distinct(list(service_name))), ',')") + " group by 1")
def trace_summaries(spark, sf_dir):
    return T.trace_summaries(_spans(spark, sf_dir)).withColumn("services", F.array_join("services", ","))


@query("trace_search_slowest", f"""
with c as (select trace_id, duration_ns as rank_ns, ts_ms from (select *, row_number() over
    (partition by trace_id order by duration_ns desc, ts_ms desc) as rn from spans
    where {IN_DAY} and service_name = 'svc-3' and span_kind in ('Server', 'Consumer'))
  where rn = 1 order by rank_ns desc, ts_ms desc, trace_id limit 30),
s as ({SUMMARY} where trace_id in (select trace_id from c) group by 1)
select c.trace_id, c.rank_ns, c.ts_ms, s.* exclude (trace_id, services), array_to_string(services, ',') as services
from c join s on s.trace_id = c.trace_id""")
def trace_search_slowest(spark, sf_dir):
    f = T.SpanFilter(range=DAY, service="svc-3").entry_by_default()
    return T.search_traces(_spans(spark, sf_dir), f, "duration", 30).withColumn("services", F.array_join("services", ","))


@query("trace_search_newest", f"""
with c as (select trace_id, max(ts_ms) as ts_ms from spans where {IN_DAY} and service_name = 'svc-4'
  and exc_type <> '' and db_system = 'mysql' group by 1 order by ts_ms desc, trace_id limit 40) select trace_id, ts_ms from c""")
def trace_search_newest(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    f = T.SpanFilter(range=DAY, service="svc-4", attrs=(AttrFilter.parse("db.system"), AttrFilter.parse("db.system=mysql")))
    hit = spans.where(T.event_attr(spans, "exception.type") != "")
    return T.candidate_traces(hit, f, "time", 40).drop("rank_ns")


@query("trace_search_newest_summaries", f"""
with c as (select trace_id, max(ts_ms) as ts_ms from spans where {IN_DAY} and service_name = 'svc-4'
  and db_system = 'mysql' group by 1 order by ts_ms desc, trace_id limit 40),
s as ({SUMMARY} where trace_id in (select trace_id from c) group by 1)
select c.trace_id, c.ts_ms, s.span_count, s.error_count, s.root_missing, s.root_service, s.duration_ns from c join s on s.trace_id = c.trace_id""")
def trace_search_newest_summaries(spark, sf_dir):
    f = T.SpanFilter(range=DAY, service="svc-4", attrs=(AttrFilter.parse("db.system=mysql"),))
    out = T.search_traces(_spans(spark, sf_dir), f, "time", 40)
    return out.select("trace_id", "ts_ms", "span_count", "error_count", "root_missing", "root_service", "duration_ns")


TRACE = "lpad('42', 32, '0')"


@query("trace_spans", f"""
select trace_id, span_id, parent_span_id, service_name, span_name, span_kind, ts_ms * 1000 as start_us, duration_ns, status_code, cluster,
  (select count(distinct span_id) from spans where trace_id = {TRACE}) > 4 as truncated
from uniq where trace_id = {TRACE} order by ts_ms, span_id limit 4""")
def trace_spans(spark, sf_dir):
    out = T.trace_spans(_spans(spark, sf_dir), "42".zfill(32), cap=4)
    return out.select("trace_id", "span_id", "parent_span_id", "service_name", "span_name", "span_kind", "start_us",
                      "duration_ns", "status_code", "cluster", "truncated")


@query("span_dedupe", "select trace_id, span_id, ts_ms, duration_ns, service_name, span_name, status_code from uniq")
def span_dedupe(spark, sf_dir):
    cols = ["timestamp", "duration_ns", "service_name", "span_name", "status_code"]
    one = T.dedupe_spans(_spans(spark, sf_dir), cols)
    return one.select("trace_id", "span_id", F.unix_millis("timestamp").alias("ts_ms"), *cols[1:])


@query("span_light_columns", """
select span_id, service_name, ts_ms * 1000 as start_us, duration_ns, 2 as n_events, parent_span_id as link, cluster from uniq
where service_name in ('svc-1', 'svc-8')""")
def span_light_columns(spark, sf_dir):
    spans = _spans(spark, sf_dir).where("service_name in ('svc-1', 'svc-8')")
    # filter on a column the copies agree on only after choosing one copy
    out = T.span_light_columns(T.dedupe_spans(_spans(spark, sf_dir), [c for c in spans.columns if not c.endswith("attributes")]))
    return out.where("service_name in ('svc-1', 'svc-8')").select(
        "span_id", "service_name", "start_us", "duration_ns", F.size("event_ts").alias("n_events"),
        F.col("link_span_ids")[0].alias("link"), "cluster")


@query("span_details", """
select trace_id, span_id, http_status, db_statement, peer, exc_type, cast(line as varchar) as line, flag from uniq where status_code = 'Error'""")
def span_details(spark, sf_dir):
    full = T.span_full_columns(T.dedupe_spans(_spans(spark, sf_dir))).where("status_code = 'Error'")
    a = F.col("attributes")
    return full.select("trace_id", "span_id", a["http.response.status_code"].alias("http_status"), a["db.statement"].alias("db_statement"),
                       F.col("resource")["host.name"].alias("peer"), F.col("events")[1]["attributes"]["exception.type"].alias("exc_type"),
                       F.col("links")[0]["attributes"]["line"].alias("line"), F.col("links")[0]["trace_state"].alias("flag"))


@query("trace_window_choice", """
with n as (select trace_id, count(distinct span_id) as n from spans group by 1)
select trace_id, 60000 as before_ms, 60000 as after_ms, n > 4 as truncated, false as narrowed from n""")
def trace_window_choice(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    at = spans.groupBy("trace_id").agg(F.min(F.unix_millis("timestamp")).alias("at_ms"))
    return T.trace_windows(spans, at, cap=4).drop("at_ms")


@query("trace_window_spans", """
select trace_id, span_id, pinned from (
  select trace_id, span_id, rn > 4 as pinned, rn, row_number() over (partition by trace_id order by span_id desc) as back
  from (select *, row_number() over (partition by trace_id order by ts_ms, span_id) as rn from uniq)) where rn <= 4 or back = 1""")
def trace_window_spans(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    at = spans.groupBy("trace_id").agg(F.min(F.unix_millis("timestamp")).alias("at_ms"))
    shown = T.clip_traces(spans, T.trace_windows(spans, at, cap=4), cap=4)
    pins = spans.groupBy("trace_id").agg(F.max("span_id").alias("span_id"))
    return T.pin_spans(shown, spans, pins).select("trace_id", "span_id", "pinned")


sqlviews.VIEWS["tree"] = """
select trace_id, span_id, parent_span_id, ts_ms, duration_ns, status_code, d as depth, hops,
  sib = '' as is_root, sib = '' and parent_span_id <> '' as orphan,
  row_number() over (partition by trace_id, sib order by ts_ms, span_id) as pos_in_set, count(*) over (partition by trace_id, sib) as set_size,
  count(*) filter (parent_span_id = '') over (partition by trace_id) = 0 as root_missing
from (
  select s.*, case when p.span_id is null then 0 when g.span_id is null then 1 else 2 end as d, coalesce(p.span_id, '') as sib,
    coalesce(p.span_id || ',', '') || coalesce(g.span_id, '') as hops
  from uniq s left join uniq p on p.trace_id = s.trace_id and p.span_id = s.parent_span_id and s.parent_span_id <> ''
    left join uniq g on g.trace_id = p.trace_id and g.span_id = p.parent_span_id and p.parent_span_id <> '')"""


def _tree(spark, sf_dir):
    cols = ["timestamp", "parent_span_id", "duration_ns", "service_name", "span_name", "status_code"]
    return R.span_tree(T.dedupe_spans(_spans(spark, sf_dir), cols))


@query("span_tree", "select trace_id, span_id, depth, is_root, orphan, pos_in_set, set_size, root_missing from tree")
def span_tree(spark, sf_dir):
    return _tree(spark, sf_dir).select("trace_id", "span_id", "depth", "is_root", "orphan", "pos_in_set", "set_size", "root_missing")


@query("span_root_cause", """
select trace_id, span_id, depth from (select *, row_number() over (partition by trace_id order by depth desc, ts_ms, span_id) as rn
  from tree where status_code = 'Error') where rn = 1""")
def span_root_cause(spark, sf_dir):
    return R.root_cause_span(_tree(spark, sf_dir)).select("trace_id", "span_id", "depth")


@query("span_root_window", """
with root as (select trace_id, span_id as root_id, ts_ms * 1000 as root_us, ts_ms * 1000 + duration_ns / 1000.0 as root_end
  from (select *, row_number() over (partition by trace_id order by ts_ms, span_id) as rn from tree where is_root) where rn = 1)
select r.trace_id, min(root_us) as start_us, cast(greatest(max(t.ts_ms * 1000 + t.duration_ns / 1000.0), min(root_us) + 1) as double) as end_us
from root r join tree t on t.trace_id = r.trace_id
where t.ts_ms * 1000 <= root_end and (t.span_id = root_id or contains(t.hops, root_id)) group by 1""")
def span_root_window(spark, sf_dir):
    cols = ["timestamp", "parent_span_id", "duration_ns", "service_name", "span_name", "status_code"]
    return R.root_window(T.dedupe_spans(_spans(spark, sf_dir), cols))


@query("span_keep_errors_and_slowest", """
with r as (select trace_id, span_id, status_code, row_number() over (partition by trace_id order by status_code = 'Error' desc,
  duration_ns desc, ts_ms, span_id) as rn from uniq)
select trace_id, span_id from r where status_code = 'Error' or rn <= 3""")
def span_keep_errors_and_slowest(spark, sf_dir):
    cols = ["timestamp", "duration_ns", "service_name", "span_name", "status_code"]
    return R.keep_errors_and_slowest(T.dedupe_spans(_spans(spark, sf_dir), cols), 3).select("trace_id", "span_id")


@query("list_services", f"select service_name as value, count(*) as count from spans where {IN_DAY} group by 1 order by 2 desc, 1 limit 200")
def list_services(spark, sf_dir):
    return T.list_services(_spans(spark, sf_dir), DAY)


@query("list_span_names", f"""
select span_name as value, count(*) as count from spans where {IN_DAY} and service_name = 'svc-2' and span_kind in ('Client', 'Producer')
group by 1 order by 2 desc, 1 limit 10""")
def list_span_names(spark, sf_dir):
    return T.list_span_names(_spans(spark, sf_dir), DAY, "svc-2", T.CLIENT_KINDS, 10)


KEY_COUNTS = ", ".join(f"('{k}', {c})" for k, c in (
    ("db.system", "db_system <> ''"), ("db.statement", "db_statement <> ''"), ("db.name", "db_name <> ''"),
    ("http.response.status_code", "true"), ("http.request.method", "span_kind = 'Server'"), ("http.route", "span_kind = 'Server'"),
    ("server.address", "peer <> ''"), ("db.query.parameter", "db_system <> ''")))


@query("attr_keys", "select key, count(*) as count from (" + " union all ".join(
    f"select '{k.split(', ')[0]}' as key from spans where service_name = 'svc-4' and {IN_DAY} and {k.split(', ', 1)[1]}"
    for k in [e.strip("()").replace("'", "", 2) for e in KEY_COUNTS.split("), (")]) + ") group by 1")
def attr_keys(spark, sf_dir):
    return T.attr_keys(_spans(spark, sf_dir), DAY, "svc-4")


@query("attr_values", f"""
select peer as value, count(*) as count from spans where {IN_DAY} and service_name = 'svc-4' and peer <> '' group by 1
order by 2 desc, 1 limit 200""")
def attr_values(spark, sf_dir):
    return T.attr_values(_spans(spark, sf_dir), DAY, "svc-4", "server.address")


HEATMAP = f"""
select $BASE + ((ts_ms - $BASE) // 900000) * 900000 as t_ms,
  greatest(cast(floor(log10(greatest(duration_ns, 1) / 1000000.0) * 4) as int), -12) as lvl, count(*) as count,
  count(*) filter (status_code = 'Error') as errors
from spans where {IN_DAY} and span_kind in ('Server', 'Consumer') group by 1, 2"""


@query("latency_heatmap", HEATMAP)
def latency_heatmap(spark, sf_dir):
    return T.latency_heatmap(_spans(spark, sf_dir), T.SpanFilter(**OPEN))


@query("latency_heatmap_totals", f"select sum(count) as total, max(count) as max_count from ({HEATMAP})")
def latency_heatmap_totals(spark, sf_dir):
    return T.heatmap_totals(T.latency_heatmap(_spans(spark, sf_dir), T.SpanFilter(**OPEN)))


KEYS = "service_name, span_kind, span_name, exc_type, exc_msg, http_status, peer"
sqlviews.VIEWS["errgroups"] = f"""
select array_to_string([{KEYS}], chr(31)) as group_id, {KEYS}, count(*) as count, count(distinct trace_id) as traces,
  min(ts_ms) as first_ms, max(ts_ms) as last_ms, arg_max(trace_id, (ts_ms, trace_id, span_id)) as sample_trace,
  arg_max(span_id, (ts_ms, trace_id, span_id)) as sample_span
from spans where status_code = 'Error' and ts_ms >= {views.BASE} and ts_ms < {views.BASE + 86_460_000} group by {KEYS}"""


def _groups(spark, sf_dir, kind="all"):
    return T.error_groups(_spans(spark, sf_dir), DAY, kind)


@query("error_groups", "select * from errgroups")
def error_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@query("error_groups_top", """
select group_id, count, (select sum(count) from errgroups where span_kind in ('Server', 'Consumer')) as total
from errgroups where span_kind in ('Server', 'Consumer') order by count desc, service_name, group_id limit 200""")
def error_groups_top(spark, sf_dir):
    return T.top_error_groups(_groups(spark, sf_dir, "entry"), limit=200).select("group_id", "count", "total")


@query("error_top_per_service", """
select service_name, group_id, count from (select *, row_number() over (partition by service_name order by count desc, group_id) as rn
 from errgroups) where rn = 1""")
def error_top_per_service(spark, sf_dir):
    return T.top_error_per_service(_groups(spark, sf_dir)).select("service_name", "group_id", "count")


@query("error_group_search", "select group_id, count from errgroups where contains(lower(exc_msg), 'part 1') or contains(lower(peer), 'part 1')")
def error_group_search(spark, sf_dir):
    return T.error_group_search(_groups(spark, sf_dir), " Part 1").select("group_id", "count")


@query("span_subtitles", """
select case when span_kind = 'Server' then 'GET /' || span_name || ' → ' || http_status
            when db_system <> '' then db_system || ' ' || db_statement else '' end as subtitle, count(*) as count from spans group by 1""")
def span_subtitles(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return spans.groupBy(T.span_subtitle(spans).alias("subtitle")).agg(F.count("*").alias("count"))


@query("id_normalization", """
select l_orderkey, l_linenumber, lpad(to_hex(l_orderkey * 97), 32, '0') as trace_id, lpad(lower(to_hex(l_partkey)), 16, '0') as span_id,
  cast(null as varchar) as bad, case l_linenumber when 1 then 'Server' when 2 then 'Client' end as kind, count(*) as n
from (select l_orderkey, l_linenumber, l_partkey from lineitem) group by all""".replace("to_hex(l_orderkey * 97)", "lower(to_hex(l_orderkey * 97))"))
def id_normalization(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, " sErVer ").when(F.col("l_linenumber") == 2, "CLIENT").otherwise("nope")
    return li.select("l_orderkey", "l_linenumber", T.normalize_trace_id(F.concat(F.lit(" "), F.hex(F.col("l_orderkey") * 97))).alias("trace_id"),
                     T.normalize_span_id(F.hex("l_partkey")).alias("span_id"),
                     T.normalize_span_id(F.concat(F.lit("z"), F.hex("l_partkey"))).alias("bad"), T.normalize_kind(kind).alias("kind"),
                     ).groupBy("l_orderkey", "l_linenumber", "trace_id", "span_id", "bad", "kind").agg(F.count("*").alias("n"))


# --- database calls -----------------------------------------------------------------------

sqlviews.VIEWS["dbcall"] = """
select * exclude (rn) from (select *, row_number() over (partition by trace_id, span_id
  order by ts_ms, duration_ns, service_name, span_name, status_code) as rn from spans where span_kind = 'Client' and db_system <> '') where rn = 1"""


@query("trace_db_calls", """
select trace_id, span_id, service_name, db_system, db_name, peer as db_server, '' as db_port, db_statement as statement,
  duration_ns, ts_ms * 1000 as start_us from dbcall""")
def trace_db_calls(spark, sf_dir):
    return D.trace_db_calls(_spans(spark, sf_dir)).select(
        "trace_id", "span_id", "service_name", "db_system", "db_name", "db_server", "db_port", "statement", "duration_ns", "start_us")


@query("trace_db_statements_filled", """
select trace_id, span_id, case when not contains(db_statement, 'k=?') then null
  else replace(replace(db_statement, 'id=?', 'id=''' || p0 || ''''), 'k=?', 'k=''' || replace(p1, '''', '''''') || '''') end as filled from dbcall""")
def trace_db_statements_filled(spark, sf_dir):
    return D.fill_statements(D.trace_db_calls(_spans(spark, sf_dir), with_params=True)).select("trace_id", "span_id", "filled")


@query("trace_db_statements_display", """
select trace_id, span_id, replace(replace(db_statement, 'id=?', 'id=' || p0), 'k=?', 'k=''' || replace(p1, '''', '''''') || '''') as filled from dbcall""")
def trace_db_statements_display(spark, sf_dir):
    calls = D.trace_db_calls(_spans(spark, sf_dir), with_params=True)
    return D.fill_statements(calls, display=True).select("trace_id", "span_id", "filled")


@query("trace_repeated_statements", """
select * exclude (rn) from (select t.trace_id, service_name, statement, times, total_ns, trace_db_ns,
  row_number() over (partition by t.trace_id order by total_ns desc, service_name, statement) as rn
  from (select trace_id, service_name, db_statement as statement, count(*) as times, sum(duration_ns) as total_ns from dbcall group by all) t
  join (select trace_id, sum(duration_ns) as trace_db_ns from dbcall group by 1) w on w.trace_id = t.trace_id where times >= 2) where rn <= 10""")
def trace_repeated_statements(spark, sf_dir):
    return D.repeated_statements(D.trace_db_calls(_spans(spark, sf_dir)), least=2)


DB_TOP = f"""
select service_name, db_system, db_name, '' as db_operation, '' as db_collection, peer as db_server, '' as db_port,
  db_statement as statement, count(*) as calls, count(*) filter (status_code = 'Error') as errors,
  quantile_disc(duration_ns, 0.5) as p50_ns, quantile_disc(duration_ns, 0.95) as p95_ns, max(duration_ns) as max_ns, sum(duration_ns) as total_ns,
  arg_max(trace_id, (duration_ns, ts_ms, trace_id, span_id)) as sample_trace, arg_max(span_id, (duration_ns, ts_ms, trace_id, span_id)) as sample_span,
  arg_max(ts_ms, (duration_ns, ts_ms, trace_id, span_id)) as sample_ms
from spans where {IN_DAY} and span_kind = 'Client' and db_system <> '' """


@query("db_calls_top_total", DB_TOP + """ group by 1, 2, 3, 4, 5, 6, 7, 8
order by total_ns desc, service_name, db_system, db_name, db_operation, db_collection, db_server, db_port, statement limit 50""")
def db_calls_top_total(spark, sf_dir):
    return D.db_calls_top(_spans(spark, sf_dir), T.SpanFilter(kinds=("Client",), **OPEN), limit=50)


@query("db_calls_top_p95", DB_TOP + """ and db_system = 'redis' group by 1, 2, 3, 4, 5, 6, 7, 8
order by p95_ns desc, service_name, db_system, db_name, db_operation, db_collection, db_server, db_port, statement limit 20""")
def db_calls_top_p95(spark, sf_dir):
    return D.db_calls_top(_spans(spark, sf_dir), T.SpanFilter(kinds=("Client",), **OPEN), system="Redis", sort="p95", limit=20)


SOURCES = [D.Source("orders-db", "mysql", "10.0.0.2", 3306, "shop", services=("svc-2",)),
           D.Source("any-mysql", "mysql", "db.internal", aliases=("10.0.0.0:3306", "10.0.0.4"), services=("svc-4", "svc-6")),
           D.Source("cache", "redis", "10.0.0.1", services=("svc-1", "svc-3"))]


@query("db_source_match", """
select db_system, db_server, service_name, case when m = 0 then null when db_system = 'redis' then 'cache' when a >= b then 'orders-db' else 'any-mysql' end as source,
  m as source_score, count(*) as calls
from (select *, greatest(a, b, c) as m from (select db_system, peer as db_server, service_name,
    case when db_system = 'mysql' then (case when peer = '10.0.0.2' then 4 else 0 end) + 2 + (case when service_name = 'svc-2' then 1 else 0 end) else 0 end as a,
    case when db_system = 'mysql' then (case when peer in ('10.0.0.0', '10.0.0.4') then 4 else 0 end) + (case when service_name in ('svc-4', 'svc-6') then 1 else 0 end) else 0 end as b,
    case when db_system = 'redis' then (case when peer = '10.0.0.1' then 4 else 0 end) + (case when service_name in ('svc-1', 'svc-3') then 1 else 0 end) else 0 end as c
  from dbcall)) group by all""")
def db_source_match(spark, sf_dir):
    calls = D.match_source(D.trace_db_calls(_spans(spark, sf_dir)), SOURCES)
    return calls.groupBy("db_system", "db_server", "service_name", "source", "source_score").agg(F.count("*").alias("calls"))


@query("statement_digest", """
with q as (select replace(replace(db_statement, 'id=?', 'id=' || p0), 'k=?', 'k=''' || replace(p1, '''', '''''') || '''') as statement,
    replace(replace(db_statement, 'k=?', 'k=?'), 'id=?', 'id=?') as digest, duration_ns // 1000000 as duration_ms, status_code = 'Error' as error, line as rows, ts_ms from dbcall)
select digest, min(statement) as sample, count(*) as calls, count(*) filter (error) as errors, avg(duration_ms) as avg_ms,
  quantile_disc(duration_ms, 0.95) as p95_ms, max(duration_ms) as max_ms, sum(duration_ms) as total_ms, sum(rows) as rows, max(ts_ms) as last_seen_ms
from q group by 1 order by total_ms desc, digest limit 100""")
def statement_digest(spark, sf_dir):
    calls = D.fill_statements(D.trace_db_calls(_spans(spark, sf_dir), with_params=True), display=True)
    log = calls.select(F.col("filled").alias("statement"), F.expr("duration_ns div 1000000").alias("duration_ms"),
                       (F.col("status_code") == "Error").alias("error"), F.expr("cast(substr(span_id, 10) as bigint) % 8").alias("rows"),
                       F.expr("start_us div 1000").alias("ts_ms"))
    return D.statement_digest(log)


@query("statement_digest_lists", '''
select replace(db_statement, 'id=?', case duration_ns // 1000 % 3 when 0 then 'id in (?, ...)' when 1 then '(id, n2) in ((?, ...), ...)' else 'id = ? and "n 1" = ?' end) as digest,
  count(*) as calls, sum(duration_ns // 1000000) as total_ms from dbcall group by 1''')
def statement_digest_lists(spark, sf_dir):
    '''Statements with lists, rows of lists, comments and quotes in place of their parameter.'''
    calls = D.trace_db_calls(_spans(spark, sf_dir))
    n, part = F.col("duration_ns").cast("string"), F.expr("duration_ns div 1000 % 3")
    rows = F.array_join(F.array_repeat(F.lit("(1, 2)"), F.expr("cast(2 + duration_ns div 1000 % 2 as int)")), " ,")
    id_is = F.when(part == 0, F.concat(F.lit("id in (1,"), n, F.lit(", 'x')"))).when(part == 1, F.concat(F.lit("(id, n2) in ("), rows, F.lit(")"))) \
        .otherwise(F.concat(F.lit("id /* not 5 ? */ = "), n, F.lit(".5 and \"n 1\" = '-- ?'")))
    text = F.replace(F.replace("statement", F.lit("k=?"), F.concat(F.lit("k='it''s "), n, F.lit("'"))), F.lit("id=?"), id_is)
    log = calls.select(text.alias("statement"), F.expr("duration_ns div 1000000").alias("duration_ms"), F.lit(False).alias("error"), F.lit(1).alias("rows"), F.lit(0).alias("ts_ms"))
    return D.statement_digest(log).select("digest", "calls", "total_ms")


@query("attributes_flattened", """
select event_id, '/' || event_type as route, cast(user_id % 5 as varchar) as status, cast(user_id as varchar) as user_id, '[1,2]' as tags, 4 as keys from events""")
def attributes_flattened(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").selectExpr("event_id", """parse_json(concat('{"http": {"route": "/', event_type,
        '", "response": {"status_code": ', cast(user_id % 5 as string), '}}, "tags": [1, 2], "user": ', cast(user_id as string), '}')) as attrs""")
    flat = events.select("event_id", flatten_attributes(events, "attrs").alias("a"))
    a = F.col("a")
    return flat.select("event_id", a["http.route"].alias("route"), a["http.response.status_code"].alias("status"), a["user"].alias("user_id"),
                       a["tags"].alias("tags"), F.size("a").alias("keys"))


@query("attribute_filters_variant", "select event_type, count(*) as count from events where user_id % 5 = 3 and event_type <> 'view' group by 1")
def attribute_filters_variant(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").selectExpr("event_type", """parse_json(concat('{"http": {"status": ',
        cast(user_id % 5 as string), '}', if(event_type = 'view', '', ', "kind": "x"'), '}')) as attrs""")
    both = AttrFilter.parse("http.status=3").holds(events, "attrs") & AttrFilter.parse("kind").holds(events, "attrs")
    return events.where(both).groupBy("event_type").agg(F.count("*").alias("count"))


@query("events_and_links_zipped", """
select trace_id, span_id, 2 as n_events, 'exception' as second_name, coalesce(exc_type, '') as second_type, '' as third_name, parent_span_id as link_span,
  '' as link_state from uniq where span_kind = 'Server'""")
def events_and_links_zipped(spark, sf_dir):
    one = T.dedupe_spans(_spans(spark, sf_dir)).where("span_kind = 'Server'")
    # parallel arrays of unequal length, as a column store keeps them
    flat = one.select("trace_id", "span_id", F.transform("events", lambda e: e["timestamp"]).alias("ts"), F.col("events.name").alias("names"),
                      F.col("events.attributes").alias("attrs"), F.col("links.span_id").alias("link_ids"))
    e = T.zip_events(F.col("ts"), F.col("names"), F.col("attrs"))
    longer = T.zip_events(F.concat("ts", F.array(F.get("ts", F.lit(0)))), F.col("names"), F.col("attrs"))
    links = T.zip_links(F.array().cast("array<string>"), F.col("link_ids"), F.array().cast("array<string>"), F.array().cast("array<string>"))
    return flat.select("trace_id", "span_id", F.size(e).cast("int").alias("n_events"), e[1]["name"].alias("second_name"),
                       e[1]["attributes"]["exception.type"].alias("second_type"), longer[2]["name"].alias("third_name"),
                       links[0]["span_id"].alias("link_span"), links[0]["trace_state"].alias("link_state"))
