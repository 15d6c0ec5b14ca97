"""Ready-made panels resolved against the metrics that exist, and drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.attrs import attr, flatten_attributes
from telespark.functions.timeaxis import Bucket
from telespark.operators.traces import is_error

# Panels by section; each lists the metrics that can feed it, best first,
# as (metric, aggregation, field, group label, attribute filter, quantiles).
RED_QS = "0.5,0.95,0.99"
SERVER_ONLY = "span.kind=SPAN_KIND_SERVER"
PANELS = {
    "http_server": {
        "http_server_rate": [
            ("http.server.request.duration", "rate", "count", "http.response.status_code", "", ""),
            ("http.server.duration", "rate", "count", "http.status_code", "", ""),
            ("http.server.request_count", "rate", "", "", "", ""),
            ("calls", "rate", "", "status.code", SERVER_ONLY, "")],
        "http_server_latency": [
            ("http.server.request.duration", "quantile", "", "", "", RED_QS),
            ("http.server.duration", "quantile", "", "", "", RED_QS),
            ("duration", "quantile", "", "", SERVER_ONLY, RED_QS)],
        "http_route_rate": [
            ("http.server.request.duration", "rate", "count", "http.route", "", ""),
            ("http.server.duration", "rate", "count", "http.route", "", ""),
            ("duration", "rate", "count", "span.name", SERVER_ONLY, "")],
        "http_route_p95": [
            ("http.server.request.duration", "quantile", "", "http.route", "", "0.95"),
            ("http.server.duration", "quantile", "", "http.route", "", "0.95")],
        "http_active": [("http.server.active_requests", "last", "", "", "", "")],
    },
    "http_client": {
        "http_client_rate": [
            ("http.client.request.duration", "rate", "count", "server.address", "", ""),
            ("http.client.duration", "rate", "count", "", "", ""),
            ("http.client.request_count", "rate", "", "", "", "")],
        "http_client_latency": [
            ("http.client.request.duration", "quantile", "", "", "", RED_QS),
            ("http.client.duration", "quantile", "", "", "", RED_QS)],
    },
    "jvm": {
        "jvm_memory": [
            ("jvm.memory.used", "last", "", "jvm.memory.type", "", ""),
            ("process.runtime.jvm.memory.usage", "last", "", "type", "", "")],
        "jvm_gc_rate": [
            ("jvm.gc.duration", "rate", "count", "jvm.gc.name", "", ""),
            ("process.runtime.jvm.gc.duration", "rate", "count", "", "", "")],
        "jvm_gc_p95": [
            ("jvm.gc.duration", "quantile", "", "jvm.gc.name", "", "0.95"),
            ("process.runtime.jvm.gc.duration", "quantile", "", "", "", "0.95")],
        "jvm_threads": [
            ("jvm.thread.count", "last", "", "jvm.thread.state", "", ""),
            ("process.runtime.jvm.threads.count", "last", "", "", "", "")],
        "jvm_cpu": [
            ("jvm.cpu.recent_utilization", "avg", "", "", "", ""),
            ("process.runtime.jvm.cpu.utilization", "avg", "", "", "", "")],
    },
    "db_pool": {
        "db_conn": [("db.client.connections.usage", "last", "", "state", "", "")],
        "db_pending": [("db.client.connections.pending_requests", "last", "", "", "", "")],
        "db_wait": [("db.client.connections.wait_time", "quantile", "", "", "", "0.95")],
        "db_use": [("db.client.connections.use_time", "quantile", "", "", "", "0.95")],
    },
    "kafka": {
        "kafka_lag": [
            ("kafka.consumer.records_lag_max", "max", "", "topic", "", ""),
            ("kafka.consumer.records_lag", "max", "", "topic", "", "")],
        "kafka_consume": [("kafka.consumer.records_consumed_rate", "avg", "", "topic", "", "")],
        "kafka_fetch": [("kafka.consumer.fetch_latency_avg", "avg", "", "", "", "")],
        "kafka_send": [("kafka.producer.record_send_rate", "avg", "", "topic", "", "")],
        "kafka_send_error": [("kafka.producer.record_error_rate", "avg", "", "topic", "", "")],
    },
    "go": {
        "go_goroutines": [("process.runtime.go.goroutines", "last", "", "", "", "")],
        "go_heap": [("process.runtime.go.mem.heap_inuse", "last", "", "", "", "")],
        "go_gc": [("process.runtime.go.gc.pause_ns", "quantile", "", "", "", "0.95")],
    },
}
# Metric labels that are span attributes of the same name.
TRACE_LABELS = (
    "http.route", "http.request.method", "http.method", "http.response.status_code", "http.status_code", "url.scheme",
    "http.scheme", "error.type", "server.address", "server.port", "net.peer.name", "db.system", "messaging.system",
    "messaging.destination.name",
)
# Resource labels and the log dimension they stand for.
LOG_LABELS = {"res:k8s.pod.name": "pod", "res:k8s.namespace.name": "namespace", "res:k8s.container.name": "container",
              "res:host.name": "host"}
# Milliseconds per unit of a duration metric.
UNIT_MS = {"s": 1000.0, "ms": 1.0, "us": 0.001, "ns": 0.000001}
DRILL_AGGS = ("quantile", "mean", "max", "avg")

PANEL_SCHEMA = ("section_no int, section string, panel_no int, panel string, variant int, metric_name string, agg string, "
                "field string, by string, attr string, q string")


def panel_table(spark, panels: dict = PANELS) -> DataFrame:
    """The panel definitions as rows (a few dozen)."""
    rows = [(si, section, pi, panel, vi, *variant)
            for si, (section, members) in enumerate(panels.items())
            for pi, (panel, variants) in enumerate(members.items())
            for vi, variant in enumerate(variants)]
    return spark.createDataFrame(rows, PANEL_SCHEMA)


def resolve_dashboard(catalog: DataFrame, panels: dict = PANELS) -> DataFrame:
    """Per panel the first variant whose metric exists; panels without one are left out."""
    table = panel_table(catalog.sparkSession, panels)
    names = catalog.select("metric_name", "metric_type", "metric_unit")
    found = names.join(table, "metric_name")
    w = Window.partitionBy("section", "panel").orderBy("variant", "metric_type", "metric_unit")
    return (found.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")
            .orderBy("section_no", "panel_no"))


def uncovered_metrics(catalog: DataFrame, panels: dict = PANELS) -> DataFrame:
    """Metrics no panel knows."""
    known = panel_table(catalog.sparkSession, panels).select("metric_name").distinct()
    return catalog.join(known, "metric_name", "left_anti")


def spikes_from_series(points: DataFrame, bucket: Bucket, by, unit: str = "", agg: str = "", service: str | None = None) -> DataFrame:
    """Turn series cells into drill-down requests: labels become span predicates.  ``service``
    is that of the page, for series that are not grouped by service.

    ``spike_id, service_name, bucket, t_ms, v, span_name, error_only, attrs, log_dims, min_ms``"""
    pairs = list(enumerate(by))

    def label(key: str) -> Column:
        at = [i for i, k in pairs if k == key]
        return F.nullif(F.get("keys", F.lit(at[0])), F.lit("")) if at else F.lit(None).cast("string")

    def pick(wanted: dict[str, str]) -> Column:
        cols = [F.struct(F.lit(out).alias("key"), F.coalesce(F.get("keys", F.lit(i)), F.lit("")).alias("value"))
                for i, k in pairs for src, out in wanted.items() if k == src]
        empty = F.array().cast("array<struct<key:string,value:string>>")
        return F.filter(F.array(*cols), lambda e: e["value"] != "") if cols else empty

    factor = UNIT_MS.get(unit.strip()) if agg in DRILL_AGGS else None
    slow = F.when(F.col("v") > 0, F.col("v") * factor) if factor else F.lit(None).cast("double")
    return points.where(F.col("v").isNotNull()).select(
        F.concat_ws("|", F.col("bucket").cast("string"), F.concat_ws("|", "keys")).alias("spike_id"),
        F.coalesce(label("service_name"), F.lit(service).cast("string")).alias("service_name"), "bucket", bucket.start(F.col("bucket")).alias("t_ms"), "v",
        label("span.name").alias("span_name"),
        F.coalesce(F.contains(F.upper(label("status.code")), F.lit("ERROR")), F.lit(False)).alias("error_only"),
        pick({k: k for k in TRACE_LABELS}).alias("attrs"), pick(LOG_LABELS).alias("log_dims"), slow.alias("min_ms"))


def drill_spans(spans: DataFrame, spikes: DataFrame, bucket: Bucket) -> DataFrame:
    """Spans behind each spike: same service, same bucket, label predicates met.

    Spikes lie on the bucket grid, so the time condition is equality of bucket numbers
    and the join is a plain equi-join that adaptive execution can split."""
    labels = F.map_filter(flatten_attributes(spans, "span_attributes"), lambda k, _: k.isin(list(TRACE_LABELS)))
    left = spans.withColumns({"bucket": bucket.index(), "__labels": labels})
    hit = _cells(left, spikes.withColumnRenamed("span_name", "want_name"))
    meets = F.forall("attrs", lambda e: F.coalesce(F.element_at("__labels", e["key"]), F.lit("")) == e["value"])
    return (hit.where(F.col("want_name").isNull() | (F.col("span_name") == F.col("want_name")))
               .where(~F.col("error_only") | is_error()).where(meets).drop("__labels"))


def _cells(rows: DataFrame, spikes: DataFrame) -> DataFrame:
    """Rows in the bucket and service of each spike; a spike without a service takes all services of its bucket."""
    named = rows.join(spikes, ["service_name", "bucket"])
    open_ones = spikes.where("service_name is null").drop("service_name")
    return named.unionByName(rows.join(open_ones, "bucket").select(*named.columns))


def drill_to_logs(logs: DataFrame, spikes: DataFrame, bucket: Bucket) -> DataFrame:
    """Log lines behind each spike: same bucket, same service and the same pod, namespace, container and host
    as far as the spike has them.  ``logs`` needs ``service_name``; a dimension it lacks matches nothing."""
    known = [n for n in LOG_LABELS.values() if n in logs.columns]
    pairs = [x for n in known for x in (F.lit(n), F.col(n))]
    dims = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    left = logs.withColumns({"bucket": bucket.index(), "__dims": dims})
    hit = _cells(left, spikes.select("spike_id", "service_name", "bucket", "log_dims"))
    meets = F.forall("log_dims", lambda e: F.coalesce(F.element_at("__dims", e["key"]), F.lit("")) == e["value"])
    return hit.where(meets).drop("__dims", "log_dims")


def drill_to_traces(spans: DataFrame, spikes: DataFrame, bucket: Bucket, n: int = 10) -> DataFrame:
    """The ``n`` slowest traces behind each spike (of spans slow enough where it is a latency)."""
    hit = drill_spans(spans, spikes, bucket)
    slow = hit.where(F.col("min_ms").isNull() | (F.col("duration_ns") >= (F.col("min_ms") * 1_000_000).cast("bigint")))
    best = slow.groupBy("spike_id", "trace_id").agg(F.max("duration_ns").alias("duration_ns"), F.count("*").alias("spans"))
    w = Window.partitionBy("spike_id").orderBy(F.desc("duration_ns"), "trace_id")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def drill_to_errors(spans: DataFrame, spikes: DataFrame, bucket: Bucket) -> DataFrame:
    """What failed in each spike's cell: ``spike_id, span_name, http_status, count``.
    A spike without rows was slow, not failing."""
    left = spans.where(is_error()).select("service_name", "span_name", attr(spans, "span_attributes", "http.response.status_code").alias("http_status"),
                                          bucket.index().alias("bucket"))
    hit = _cells(left, spikes.select("spike_id", "service_name", "bucket", F.col("span_name").alias("want_name")))
    return (hit.where(F.col("want_name").isNull() | (F.col("span_name") == F.col("want_name")))
               .groupBy("spike_id", "span_name", "http_status").agg(F.count("*").alias("count")))
