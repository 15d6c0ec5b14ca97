"""Observability tables derived from the star-schema test data.

Every derivation is a map over rows (bills also join small dimensions), so each
scales with its input and needs no window over hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = 1_704_067_200_000        # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per order line; lines 1..7 of an order form a binary tree, repeated
    line numbers become retried copies of a span."""
    flat = table(spark, sf_dir, "lineitem").selectExpr(
        f"timestamp_millis({BASE} + (l_orderkey * 1299709) % 86400000 + l_linenumber * 5) as timestamp",
        "lpad(cast(l_orderkey as string), 32, '0') as trace_id",
        "lpad(cast(l_orderkey * 8 + l_linenumber as string), 16, '0') as span_id",
        "case when l_linenumber = 1 then '' else lpad(cast(l_orderkey * 8 + l_linenumber div 2 as string), 16, '0') end as parent_span_id",
        "'' as trace_state",
        # half the day: one operation is renamed, another gets three times as slow
        """case when l_partkey % 20 = 10 and (l_orderkey * 1299709) % 86400000 >= 43200000 then 'op-new'
           else concat('op-', cast(l_partkey % 20 as string)) end as span_name""",
        """case when l_linenumber = 1 then 'Server' when l_partkey % 5 = 0 then 'Consumer' when l_partkey % 5 = 1 then 'Internal'
           when l_partkey % 5 = 2 then 'Producer' else 'Client' end as span_kind""",
        "concat('svc-', cast(l_suppkey % 10 as string)) as service_name",
        """cast(round(l_extendedprice * 100) as bigint) * 1000
           * if(l_partkey % 20 = 5 and (l_orderkey * 1299709) % 86400000 >= 43200000, 3, 1) as duration_ns""",
        "case when l_returnflag = 'R' and l_partkey % 4 = 0 then 'Error' else 'Unset' end as status_code",
        "'' as status_message", "'lib' as scope_name", "'1' as scope_version",
        "concat('zone-', cast(l_suppkey % 3 as string)) as cluster",
        "case when l_partkey % 5 >= 3 then case when l_suppkey % 2 = 0 then 'mysql' else 'redis' end else '' end as db_system",
        """case when l_partkey % 3 = 0 then concat('select * from t', cast(l_partkey % 12 as string), ' where id=? and k=?')
           else concat('select * from t', cast(l_partkey % 12 as string), ' where id=?') end as db_statement""",
        "cast(l_suppkey as string) as p0", "concat('it''s ', cast(l_linenumber as string)) as p1",
        "case when l_returnflag = 'R' and l_partkey % 8 = 0 then concat('java.lang.E', cast(l_partkey % 3 as string)) else '' end as exc_type",
        "case when l_returnflag = 'R' and l_partkey % 8 = 0 then concat('fail on part ', cast(l_partkey % 20 as string)) else '' end as exc_msg",
        "case when l_partkey % 4 = 0 then '500' else '200' end as http_status",
        "case when l_suppkey % 2 = 0 then concat('10.0.0.', cast(l_suppkey % 6 as string)) else '' end as peer",
        "l_linenumber as line", "l_returnflag as flag",
    )
    return flat.selectExpr(
        "timestamp", "trace_id", "span_id", "parent_span_id", "trace_state", "span_name", "span_kind", "service_name",
        "duration_ns", "status_code", "status_message", "scope_name", "scope_version", "cluster",
        "map('host.name', peer, 'k8s.pod.name', concat(service_name, '-', cluster)) as resource_attributes",
        """map('db.system', db_system, 'db.statement', if(db_system = '', '', db_statement), 'db.name', if(db_system = '', '', 'shop'),
               'http.response.status_code', http_status, 'http.request.method', if(span_kind = 'Server', 'GET', ''),
               'http.route', if(span_kind = 'Server', concat('/', span_name), ''), 'server.address', peer,
               'db.query.parameter', if(db_system = '', '', concat('{"0":"', p0, '","1":"', p1, '"}'))) as span_attributes""",
        """array(named_struct('timestamp', timestamp, 'name', 'start', 'attributes', map('exception.type', '', 'exception.message', '')),
                 named_struct('timestamp', timestamp, 'name', 'exception', 'attributes',
                              map('exception.type', exc_type, 'exception.message', exc_msg))) as events""",
        """array(named_struct('trace_id', trace_id, 'span_id', parent_span_id, 'trace_state', flag,
                              'attributes', map('line', cast(line as string)))) as links""",
    )


def app_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines from ``events`` and long ones from whole ``documents``."""
    short = table(spark, sf_dir, "events").selectExpr(
        "cast(ts as timestamp) as timestamp",
        "concat('svc-', cast(user_id % 10 as string)) as service_name",
        "case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' when 'click' then 'DEBUG' else 'INFO' end as level",
        "concat('app.', event_type) as logger", "concat('Worker-', cast(event_id % 4 as string)) as thread",
        "lpad(cast(event_id as string), 32, '0') as trace_id", "'' as span_id",
        "concat('ns-', cast(user_id % 3 as string)) as namespace", "concat('pod-', cast(user_id % 20 as string)) as pod",
        "'' as cluster", "concat('host-', cast(user_id % 7 as string)) as host",
        "concat('/var/log/app-', cast(user_id % 3 as string), '.log') as file",
        """concat(event_type, ' user=', cast(user_id as string), ' req=rq', lpad(cast(event_id as string), 16, '0'),
                  ' order=', cast(20240000 + event_id as string), ' props=', props) as message""")
    long = table(spark, sf_dir, "documents").selectExpr(
        f"timestamp_millis({BASE} + (doc_id * 1299709) % 86400000 + 20) as timestamp",
        "concat('svc-', cast(doc_id % 10 as string)) as service_name",
        "case lang when 'fr' then 'WARN' when 'de' then 'ERROR' else 'INFO' end as level",
        "concat('doc.', lang) as logger", "'main' as thread",
        "lpad(cast(doc_id as string), 32, '0') as trace_id", "'' as span_id",
        "'docs' as namespace", "concat('pod-', cast(doc_id % 20 as string)) as pod", "'' as cluster",
        "concat('host-', cast(doc_id % 7 as string)) as host", "concat('/var/log/', source, '.log') as file", "text as message")
    return short.unionByName(long)


def otel_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is one scrape of one metric of a pod.  Counters grow with the time
    since the last half-day restart, at a rate that belongs to the series."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(ts as timestamp) as timestamp", "unix_millis(cast(ts as timestamp)) as ts_ms",
        "user_id % 4 as svc", "user_id % 24 as pod", "event_type as route", "event_id",
        "cast(round(value * 100) as bigint) as cents",
        "(unix_millis(cast(ts as timestamp)) % 43200000) div 1000 as up",
    ).selectExpr(
        "timestamp", "timestamp_millis(ts_ms - up * 1000) as start_timestamp",
        "case route when 'error' then 'queue.size' when 'purchase' then 'latency' when 'view' then 'bytes' else 'requests' end as metric_name",
        "case route when 'error' then 'Gauge' when 'purchase' then 'Histogram' else 'Sum' end as metric_type",
        "case route when 'purchase' then 'ms' when 'view' then 'By' else '1' end as metric_unit",
        "concat('about ', route) as metric_description",
        "concat('svc-', cast(svc as string)) as service_name", "'meter' as scope_name", "'1' as scope_version",
        "map('k8s.pod.name', concat('pod-', cast(pod as string)), 'zone', '') as resource_attributes",
        "map('http.route', concat('/', route), 'code', if(pod % 5 = 0, '500', '200')) as attributes",
        """cast(case route when 'error' then cents when 'view' then cents when 'purchase' then 0
                else up * (1 + pod % 7) end as double) as value""",
        "case route when 'view' then 'Delta' else 'Cumulative' end as temporality",
        "route in ('click', 'signup') as is_monotonic",
        "if(route = 'purchase', up * (1 + pod % 3) * 4, 0) as count",
        "cast(if(route = 'purchase', up * (1 + pod % 3) * (90 + pod), 0) as double) as sum",
        "cast(0 as double) as min", "cast(0 as double) as max",
        """if(route = 'purchase', array(up * (1 + pod % 3), up * (1 + pod % 2), up * (1 + pod % 5), up div 10),
              cast(array() as array<bigint>)) as bucket_counts""",
        """if(route = 'purchase', array(cast(10 as double), cast(50 as double), cast(100 as double)),
              cast(array() as array<double>)) as explicit_bounds""",
        "cast(array() as array<struct<quantile:double,value:double>>) as quantiles",
        """if(route = 'purchase', array(named_struct('timestamp', timestamp, 'value', cast(cents as double),
              'trace_id', lpad(cast(event_id as string), 32, '0'), 'span_id', lpad(cast(event_id as string), 16, '0'))),
              cast(array() as array<struct<timestamp:timestamp,value:double,trace_id:string,span_id:string>>)) as exemplars""",
        "cast(0 as bigint) as flags")


def _billed(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """Bill lines of one provider with repeated syncs, corrected amounts and parallel lines.
    One scan of the order lines; each becomes one to four synced rows."""
    lines = table(spark, sf_dir, "lineitem").where(f"l_suppkey % 2 = {parity}")
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    joined = (lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
              .join(nation, supplier.s_nationkey == nation.n_nationkey))
    base = joined.selectExpr(
        "date_add(date'2024-01-01', datediff(cast(l_shipdate as date), date'1995-01-01') % 900) as d",
        "p_type", "p_brand", "n_name", "l_suppkey", "l_partkey", "l_orderkey * 8 + l_linenumber as n",
        "if(l_linestatus = 'F', 'Subscription', 'PayAsYouGo') as subscription", "cast(cast(l_quantity as int) as string) as usage",
        "cast(round(l_extendedprice * 100) as bigint) as cents", "cast(round(l_discount * 100) as bigint) as off")
    synced = base.selectExpr("*", """inline(filter(array(
        named_struct('s', 0, 'every', 1, 'k', 1, 'plus', 0), named_struct('s', 86400, 'every', 5, 'k', 1, 'plus', 0),
        named_struct('s', 172800, 'every', 10, 'k', 1, 'plus', 100), named_struct('s', 172801, 'every', 20, 'k', 0, 'plus', -50)),
        c -> n % c.every = 0))""")
    return synced.selectExpr(
        "*", "cents * (100 - off) * k + plus as payable_e4", "cents * 100 * k as original_e4", "cents * 50 * k as paid_e4",
        "timestamp'2026-07-01 00:00:00' + make_dt_interval(0, 0, 0, s) as updated_at")


def alicloud_bill(spark: SparkSession, sf_dir: str, daily: bool = True) -> DataFrame:
    return _billed(spark, sf_dir, 0).selectExpr(
        "date_format(d, 'yyyy-MM') as billing_cycle", *(["d as billing_date"] if daily else ["cast(null as date) as billing_date"]),
        "concat('c-', p_type) as product_code", "if(l_partkey % 7 = 0, '', p_type) as product_name", "'' as product_type",
        "p_brand as product_detail", "concat('i-', cast(l_suppkey as string)) as instance_id", "'' as instance_name",
        "concat('acct-', cast(l_suppkey % 4 as string)) as bill_account_id", "'' as bill_account_name",
        "subscription as subscription_type", "if(l_suppkey % 10 = 8, '', n_name) as region", "concat('z', cast(l_suppkey % 3 as string)) as zone",
        "concat('proj-', cast(l_partkey % 5 as string)) as resource_group", "'' as cost_unit", "'CNY' as currency", "usage", "'h' as usage_unit",
        "payable_e4 / 10000D as pretax_amount", "paid_e4 / 10000D as payment_amount", "original_e4 / 10000D as pretax_gross_amount",
        "case l_partkey % 3 when 0 then '1' when 1 then cast(1 + l_partkey % 6 as string) else '90' end as service_period",
        "case l_partkey % 3 when 0 then '年' when 1 then '月' else '天' end as service_period_unit",
        "concat('10.0.1.', cast(l_suppkey % 50 as string)) as intranet_ip", "n as line_id", "updated_at")


def volcengine_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older layout: money as text, now and then not a number."""
    def money(e4):
        return f"cast(cast(cast({e4} as decimal(20,8)) * 0.0001BD as decimal(20,8)) as string)"

    return _billed(spark, sf_dir, 1).selectExpr(
        "date_format(d, 'yyyy-MM') as BillPeriod", "date_format(d, 'yyyy-MM-dd') as ExpenseDate", "'' as ExpenseBeginTime",
        "concat('i-', cast(l_suppkey as string)) as InstanceNo", "'' as InstanceName", "concat('c-', p_type) as Product",
        "if(l_partkey % 7 = 0, '', p_type) as ProductZh", "p_brand as Element", "'' as ElementCode",
        "if(l_suppkey % 10 = 9, '', n_name) as Region", "concat('r-', n_name) as RegionCode",
        "concat('z', cast(l_suppkey % 3 as string)) as Zone", "'' as ZoneCode", "concat('acct-', cast(l_suppkey % 4 as string)) as OwnerID",
        "'' as OwnerUserName", "'' as OwnerCustomerName", "concat('proj-', cast(l_partkey % 5 as string)) as Project",
        "'' as ProjectDisplayName", "subscription as BillingMode", "'CNY' as Currency", "usage as Count", "'h' as Unit",
        f"{money('payable_e4')} as PayableAmount", f"if(n % 97 = 0, 'n/a', {money('paid_e4')}) as PaidAmount",
        f"{money('original_e4')} as OriginalBillAmount", "n as line_id", "updated_at")
