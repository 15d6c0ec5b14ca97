"""The derived tables of ``views`` once more, as plain SQL for the row-by-row check."""

from __future__ import annotations

import re

from telespark.plans.views import BASE

SPANS = """
select $BASE + (l_orderkey * 1299709) % 86400000 + l_linenumber * 5 as ts_ms,
  lpad(cast(l_orderkey as varchar), 32, '0') as trace_id,
  lpad(cast(l_orderkey * 8 + l_linenumber as varchar), 16, '0') as span_id,
  case when l_linenumber = 1 then '' else lpad(cast(l_orderkey * 8 + l_linenumber // 2 as varchar), 16, '0') end as parent_span_id,
  case when l_partkey % 20 = 10 and (l_orderkey * 1299709) % 86400000 >= 43200000 then 'op-new'
       else 'op-' || cast(l_partkey % 20 as varchar) end as span_name,
  case when l_linenumber = 1 then 'Server' when l_partkey % 5 = 0 then 'Consumer' when l_partkey % 5 = 1 then 'Internal'
       when l_partkey % 5 = 2 then 'Producer' else 'Client' end as span_kind,
  'svc-' || cast(l_suppkey % 10 as varchar) as service_name,
  cast(round(l_extendedprice * 100) as bigint) * 1000
    * case when l_partkey % 20 = 5 and (l_orderkey * 1299709) % 86400000 >= 43200000 then 3 else 1 end as duration_ns,
  case when l_returnflag = 'R' and l_partkey % 4 = 0 then 'Error' else 'Unset' end as status_code,
  'zone-' || cast(l_suppkey % 3 as varchar) as cluster,
  case when l_partkey % 5 >= 3 then case when l_suppkey % 2 = 0 then 'mysql' else 'redis' end else '' end as db_system,
  case when l_partkey % 5 < 3 then '' when l_partkey % 3 = 0
       then 'select * from t' || cast(l_partkey % 12 as varchar) || ' where id=? and k=?'
       else 'select * from t' || cast(l_partkey % 12 as varchar) || ' where id=?' end as db_statement,
  case when l_partkey % 5 >= 3 then 'shop' else '' end as db_name,
  cast(l_suppkey as varchar) as p0, 'it''s ' || cast(l_linenumber as varchar) as p1,
  case when l_returnflag = 'R' and l_partkey % 8 = 0 then 'java.lang.E' || cast(l_partkey % 3 as varchar) else '' end as exc_type,
  case when l_returnflag = 'R' and l_partkey % 8 = 0 then 'fail on part ' || cast(l_partkey % 20 as varchar) else '' end as exc_msg,
  case when l_partkey % 4 = 0 then '500' else '200' end as http_status,
  case when l_suppkey % 2 = 0 then '10.0.0.' || cast(l_suppkey % 6 as varchar) else '' end as peer,
  l_linenumber as line, l_returnflag as flag
from lineitem"""

APP_LOG = """
select epoch_us(ts) as ts_us, epoch_us(ts) // 1000 as ts_ms, 'svc-' || cast(user_id % 10 as varchar) as service_name,
  case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' when 'click' then 'DEBUG' else 'INFO' end as level,
  'app.' || event_type as logger, 'Worker-' || cast(event_id % 4 as varchar) as thread,
  lpad(cast(event_id as varchar), 32, '0') as trace_id, '' as span_id,
  'ns-' || cast(user_id % 3 as varchar) as namespace, 'pod-' || cast(user_id % 20 as varchar) as pod, '' as cluster,
  'host-' || cast(user_id % 7 as varchar) as host, '/var/log/app-' || cast(user_id % 3 as varchar) || '.log' as file,
  event_type || ' user=' || cast(user_id as varchar) || ' req=rq' || lpad(cast(event_id as varchar), 16, '0')
    || ' order=' || cast(20240000 + event_id as varchar) || ' props=' || props as message
from events
union all
select ($BASE + (doc_id * 1299709) % 86400000 + 20) * 1000, $BASE + (doc_id * 1299709) % 86400000 + 20, 'svc-' || cast(doc_id % 10 as varchar),
  case lang when 'fr' then 'WARN' when 'de' then 'ERROR' else 'INFO' end, 'doc.' || lang, 'main',
  lpad(cast(doc_id as varchar), 32, '0'), '', 'docs', 'pod-' || cast(doc_id % 20 as varchar), '',
  'host-' || cast(doc_id % 7 as varchar), '/var/log/' || source || '.log', text
from documents"""

METRIC = """
select *, case when route = 'purchase' then [up * (1 + pod % 3), up * (1 + pod % 2), up * (1 + pod % 5), up // 10] end as bucket_counts,
  cast(case route when 'error' then cents when 'view' then cents when 'purchase' then 0 else up * (1 + pod % 7) end as double) as value,
  case when route = 'purchase' then up * (1 + pod % 3) * 4 else 0 end as count,
  cast(case when route = 'purchase' then up * (1 + pod % 3) * (90 + pod) else 0 end as double) as sum,
  case route when 'view' then 'Delta' else 'Cumulative' end as temporality,
  case route when 'error' then 'queue.size' when 'purchase' then 'latency' when 'view' then 'bytes' else 'requests' end as metric_name,
  case route when 'error' then 'Gauge' when 'purchase' then 'Histogram' else 'Sum' end as metric_type,
  case route when 'purchase' then 'ms' when 'view' then 'By' else '1' end as metric_unit,
  'svc-' || cast(svc as varchar) as service_name, 'pod-' || cast(pod as varchar) as pod_name,
  case when pod % 5 = 0 then '500' else '200' end as code
from (select epoch_us(ts) as ts_us, epoch_us(ts) // 1000 as ts_ms, user_id % 4 as svc, user_id % 24 as pod, event_type as route, event_id,
        cast(round(value * 100) as bigint) as cents, ((epoch_us(ts) // 1000) % 43200000) // 1000 as up from events)"""

BILL = """
select provider, strftime(d, '%Y-%m') as period, strftime(d, '%Y-%m-%d') as day, product, item, instance_id, region, zone, account, project, subscription,
  usage, ip, months, n, c.s as sync_s, payable_e4 * c.k + c.plus as payable_e4, original_e4 * c.k as original_e4,
  case when provider = 'volcengine' and n % 97 = 0 then 0 else paid_e4 * c.k end as paid_e4
from (
  select case when l_suppkey % 2 = 0 then 'alicloud' else 'volcengine' end as provider,
    date '2024-01-01' + cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) % 900 as int) as d,
    case when l_partkey % 7 = 0 then 'c-' || p_type else p_type end as product, p_brand as item, 'i-' || cast(l_suppkey as varchar) as instance_id,
    case when l_suppkey % 10 = 8 then '' when l_suppkey % 10 = 9 then 'r-' || n_name else n_name end as region, 'z' || cast(l_suppkey % 3 as varchar) as zone,
    'acct-' || cast(l_suppkey % 4 as varchar) as account, 'proj-' || cast(l_partkey % 5 as varchar) as project,
    case when l_linestatus = 'F' then 'Subscription' else 'PayAsYouGo' end as subscription, cast(cast(l_quantity as int) as varchar) as usage,
    '10.0.1.' || cast(l_suppkey % 50 as varchar) as ip, case l_partkey % 3 when 0 then 12 when 1 then 1 + l_partkey % 6 else 3 end as months,
    l_orderkey * 8 + l_linenumber as n, cast(round(l_extendedprice * 100) as bigint) * 100 as original_e4,
    cast(round(l_extendedprice * 100) as bigint) * 50 as paid_e4,
    cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint)) as payable_e4
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey) b
join (values (0, 1, 1, 0), (86400, 5, 1, 0), (172800, 10, 1, 100), (172801, 20, 0, -50)) c(s, every, k, plus) on b.n % c.every = 0"""


def _deduped(key: str) -> str:
    carried = "provider period product item instance_id region zone account project subscription usage ip months".split()
    keys = f"provider, {key}, n"
    carried = [c for c in carried if c not in keys.split(", ")]
    day = "any_value(day) as day" if key == "period" else "any_value(period) as period"
    return f"""
select * exclude (newest) from (select *, max(v) over (partition by {keys}) as newest from (
  select {keys}, payable_e4, paid_e4, original_e4, max(sync_s) as v, {day}, {', '.join(f'any_value({c}) as {c}' for c in carried if c != 'period')}
  from bill group by {keys}, payable_e4, paid_e4, original_e4)) where v >= newest - 60"""


VIEWS = {"spans": SPANS, "app_log": APP_LOG, "metric": METRIC, "bill": BILL, "bill_d": _deduped("day"), "bill_m": _deduped("period")}


def fill(sql: str, consts: dict) -> str:
    consts = {"BASE": BASE, "DAY_END": BASE + 86_460_000, "MONTH_END": BASE + 31 * 86_400_000, **consts}
    for name in sorted(consts, key=len, reverse=True):
        sql = sql.replace(f"${name}", str(consts[name]))
    return sql


def with_views(sql: str) -> str:
    """Prefix the views a statement mentions."""
    chosen: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(body)
                chosen.append(name)

    need(sql)
    if not chosen:
        return sql
    ctes = ",\n".join(f"{n} as ({fill(VIEWS[n], {})})" for n in chosen)
    body = sql.strip()
    if re.match(r"with\b", body, re.I):
        return f"with {ctes},\n{body[4:].lstrip()}"
    return f"with {ctes}\n{body}"
