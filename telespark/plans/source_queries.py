"""Queries that read through the loaders and through a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from telespark.functions.lineage import written
from telespark.operators import bills as B
from telespark.operators import logs as L
from telespark.plans import views
from telespark.plans.bill_queries import ALL
from telespark.plans.registry import query
from telespark.sources import schema as S
from telespark.streaming import tail


@query("load_logs", "select level, host, count(*) as lines, sum(length(message)) as chars from app_log group by all")
def load_logs(spark, sf_dir):
    logs = S.load_logs(spark, written(views.app_log(spark, sf_dir), "logs"))
    return logs.groupBy("level", "host").agg(F.count("*").alias("lines"), F.sum(F.length("message")).alias("chars"))


@query("load_spans", "select service_name, span_kind, count(*) as spans, sum(duration_ns)::bigint as total_ns from spans group by all")
def load_spans(spark, sf_dir):
    spans = S.load_spans(spark, written(views.spans(spark, sf_dir), "spans"))
    return spans.groupBy("service_name", "span_kind").agg(F.count("*").alias("spans"), F.sum("duration_ns").alias("total_ns"))


@query("load_metrics", "select metric_name, metric_type, count(*) as points from metric group by all")
def load_metrics(spark, sf_dir):
    points = S.load_metrics(spark, written(views.otel_metric(spark, sf_dir), "metrics")).df
    return points.groupBy("metric_name", "metric_type").agg(F.count("*").alias("points"))


@query("load_bills_default_key", """
select provider, zone, count(*) as lines, sum(payable_e4)::bigint as payable_e4, sum(original_e4)::bigint as original_e4 from bill_d group by all""")
def load_bills_default_key(spark, sf_dir):
    """Many lines of one product, instance and zone, told apart by the fixed key's last columns only."""
    ali = views.alicloud_bill(spark, sf_dir).selectExpr(
        "*", "'PayAsYouGo' as billing_type", "'bill' as item", "'' as biz_type", "product_detail as product_detail_code",
        "cast(line_id div 4 as string) as split_item_id", "cast(line_id % 4 as int) as line_seq")
    volc = views.volcengine_bill(spark, sf_dir).selectExpr("*", "cast(line_id as string) as BillDetailId")
    names = {"volcengine": "loaded_volcengine_bill", "alicloud_daily": "loaded_alicloud_bill_daily", "alicloud_monthly": "loaded_no_such_bill"}
    volc.createOrReplaceTempView(names["volcengine"])
    ali.createOrReplaceTempView(names["alicloud_daily"])
    sources = B.pick_sources(S.load_bills(spark, names), by_day=True)
    lines = B.bill_lines(sources, ALL)
    e4 = lambda c: F.sum(F.round(F.col(c).cast("double") * 10_000).cast("bigint"))
    return lines.groupBy("provider", "zone").agg(F.count("*").alias("lines"), e4("amount").alias("payable_e4"), e4("original").alias("original_e4"))


@query("log_tail_stream", """
select ts_ms, trace_id, level, host, message_len from (
  select distinct ts_us, ts_ms, host, file, thread, logger, message, trace_id, level, length(message) as message_len from app_log where level in ('ERROR', 'WARN'))""")
def log_tail_stream(spark, sf_dir):
    """A follow query that really runs: files arrive one batch after the other, some lines a second time."""
    logs = views.app_log(spark, sf_dir)
    source = written(logs.unionByName(logs.where("level = 'ERROR'")).repartitionByRange(4, "timestamp"), "arriving")
    out = written(logs.where("false").select("host"), "followed") + "-lines"
    state = out + "-state"
    stream = tail.read_stream(spark, source, logs.schema, files_per_trigger=2)
    run = tail.start_tail(stream, L.LogFilter(None, levels=("ERROR", "WARN")),
                          lambda rows, number: rows.write.mode("append").parquet(out), state, once=True)
    tail.drain(run, 600)
    return spark.read.parquet(out).select("ts_ms", "trace_id", "level", "host", F.col("message_len").cast("bigint").alias("message_len"))
