import pytest
from pyspark.sql import functions as F

from telespark.functions import histogram as H
from telespark.functions.timeaxis import Bucket, TimeRange
from telespark.operators import dashboards as P
from telespark.operators import metrics as M

R = TimeRange(0, 400_000)
B = Bucket(100_000, 0)
COLS = ("ms long, metric_name string, metric_type string, service_name string, pod string, value double, count long, sum double, "
        "temporality string, bucket_counts array<bigint>, explicit_bounds array<double>")


def points(spark, rows):
    full = [(r["ms"], r.get("name", "m"), r.get("type", "Sum"), r.get("service", "s"), r.get("pod", "p"), r.get("v", 0.0), r.get("n", 0), r.get("sum", 0.0),
             r.get("temp", "Cumulative"), r.get("counts", []), r.get("bounds", [])) for r in rows]
    return spark.createDataFrame(full, COLS).withColumns({
        "timestamp": F.timestamp_millis("ms"), "scope_name": F.lit(""), "metric_unit": F.lit(""), "metric_description": F.lit("d"),
        "is_monotonic": F.lit(True), "resource_attributes": F.create_map(F.lit(M.POD), "pod"), "attributes": F.create_map(F.lit("k"), F.lit("v"))})


def values(df):
    return {r.bucket: r.v for r in df.collect()}


F_M = M.MetricFilter(R, "m")


def test_increase_and_reset(spark):
    df = points(spark, [{"ms": 10_000, "v": 5.0}, {"ms": 90_000, "v": 8.0}, {"ms": 150_000, "v": 20.0}, {"ms": 250_000, "v": 3.0}])
    assert values(M.series(df, F_M, "increase", bucket=B)) == {0: None, 1: 12.0, 2: 3.0}


def test_rate_uses_the_real_gap(spark):
    df = points(spark, [{"ms": 90_000, "v": 10.0}, {"ms": 340_000, "v": 60.0}])
    assert values(M.series(df, F_M, "rate", bucket=B)) == {0: None, 3: 50.0 / 250}
    delta = points(spark, [{"ms": 10_000, "v": 10.0, "temp": "Delta"}, {"ms": 20_000, "v": 30.0, "temp": "Delta"}])
    assert values(M.series(delta, F_M, "rate", bucket=B)) == {0: 0.4}


def test_pods_are_separate_series(spark):
    rows = [{"ms": m, "v": v, "pod": p} for p, off in (("a", 0.0), ("b", 1000.0)) for m, v in ((10_000, off), (110_000, off + 7))]
    assert values(M.series(points(spark, rows), F_M, "increase", bucket=B)) == {0: None, 1: 14.0}


def test_mean(spark):
    df = points(spark, [{"ms": 0, "n": 2, "sum": 10.0}, {"ms": 150_000, "n": 6, "sum": 30.0}, {"ms": 250_000, "n": 6, "sum": 30.0}])
    assert values(M.series(df, F_M, "mean", "sum", bucket=B)) == {0: None, 1: 5.0, 2: None}


@pytest.mark.parametrize("counts,bounds,q,want", [
    ([10, 10, 10], [10.0, 20.0], 0.5, 15.0), ([0, 0, 5], [10.0, 50.0], 0.9, 50.0), ([0, 0, 0], [10.0, 20.0], 0.5, None),
    ([4, 0], [10.0], 0.5, 5.0), ([4, 4], [-10.0], 0.25, -10.0), ([1, 2], [], 0.5, None), ([0, 4], [10.0], 0.0, 10.0),
])
def test_quantile(spark, counts, bounds, q, want):
    df = spark.createDataFrame([(counts, bounds)], "c array<bigint>, b array<double>")
    assert df.select(H.quantile(F.col("c"), F.col("b"), q)).head()[0] == want


def test_labels():
    assert [H.quantile_label(q) for q in (0.5, 0.95, 0.999)] == ["p50", "p95", "p99.9"]
    with pytest.raises(ValueError):
        H.quantile(F.lit(1), F.lit(1), 95)


def test_histograms(spark):
    b2, b3 = [1.0], [1.0, 2.0]
    df = points(spark, [
        {"ms": 10_000, "counts": [1, 1], "bounds": b2}, {"ms": 110_000, "counts": [4, 3], "bounds": b2}, {"ms": 210_000, "counts": [1, 5], "bounds": b2},
        {"ms": 120_000, "counts": [7, 7, 7], "bounds": b3, "pod": "q"}, {"ms": 130_000, "counts": [2, 2], "bounds": b2, "temp": "Delta"},
        {"ms": 140_000, "counts": [1, 0], "bounds": b2, "temp": "Delta"}])
    got = {(r.bucket, len(r.bounds)): r.counts for r in M.histogram_increase(df, F_M, bucket=B).collect()}
    # the first cumulative point counts nothing, a falling bucket counts whole, other bounds stay apart
    assert got == {(0, 1): [0, 0], (1, 1): [6, 4], (1, 2): [0, 0, 0], (2, 1): [1, 2]}


def test_alignment_and_top(spark):
    pts = spark.createDataFrame([(0, ["a"], 1.0), (2, ["a"], 3.0), (1, ["b"], 10.0), (3, ["c"], -2.0), (99, ["b"], 9.0)], "bucket long, keys array<string>, v double")
    rows = M.align_series(pts, R, B, ("service_name",), limit=2).orderBy("rank").collect()
    assert [r.name for r in rows] == ["service_name=b", "service_name=a"]
    assert rows[0]["values"] == [None, 10.0, None, None] and rows[1]["values"] == [1.0, None, 3.0, None]
    assert (rows[1]["min"], rows[1]["max"], rows[1].avg, rows[1].last, rows[1].truncated) == (1.0, 3.0, 2.0, 3.0, True)
    assert {r.truncated for r in M.top_series(pts, 5).collect()} == {False}


def test_fold_keeps_null_only_tails_null(spark):
    pts = spark.createDataFrame([(0, ["a"], 5.0), (0, ["b"], None), (1, ["b"], 1.0), (1, ["c"], 2.0), (0, ["c"], None)], "bucket long, keys array<string>, v double")
    got = {(r.t_ms, r.other): r.v for r in M.fold_other(pts, R, B, keep=1).collect()}
    assert got == {(0, False): 5.0, (0, True): None, (100_000, True): 3.0}


def test_kinds(spark):
    kind = M.MetricKind("Histogram", False, True)
    assert (kind.default_agg(), kind.default_field("rate"), kind.default_field("mean")) == ("quantile", "count", "sum")
    assert M.MetricKind("Summary", False, False).default_agg() == "mean"
    assert M.MetricKind("Sum", True, False).default_agg() == "rate" and M.MetricKind("Sum", False, False).default_agg() == "last"
    assert M.MetricKind("Gauge", False, False).default_agg() == "avg"
    for k, agg, field in ((kind, "avg", "value"), (M.MetricKind("Summary", False, False), "quantile", "sum"),
                          (M.MetricKind("Gauge", False, False), "quantile", "value"), (M.MetricKind("Sum", True, False), "rate", "count")):
        with pytest.raises(ValueError):
            k.check(agg, field)
    df = points(spark, [{"ms": 0, "type": "Histogram", "bounds": [1.0]}])
    assert M.metric_kind(df, F_M) == M.MetricKind("Histogram", True, True) and M.metric_kind(df, M.MetricFilter(R, "x")) is None


def test_events_across_chunks(spark):
    h = 3_600_000
    r = TimeRange(0, 10 * h)
    df = points(spark, [{"ms": 0, "v": 5.0}, {"ms": 5 * h, "v": 9.0}, {"ms": 7 * h, "v": 2.0}, {"ms": 7 * h + 1, "v": 3.0}, {"ms": 8 * h, "v": 1.0, "pod": "late"}])
    got = [(e.t_ms, e.kind, e.pod) for e in M.metric_events(df, M.MetricFilter(r, "m")).collect()]
    assert got == [(7 * h, "restart", "p"), (8 * h, "start", "late")]


def test_events_of_mixed_types(spark):
    rows = [{"ms": i * 1000, "v": v, "service": "a"} for i, v in enumerate((5.0, 9.0, 2.0))]
    rows += [{"ms": i * 1000, "n": n, "service": "b", "type": "Histogram"} for i, n in enumerate((7, 3, 4))]
    rows += [{"ms": i * 1000 + 1, "service": "c", **kind} for i, kind in enumerate(({"v": 8.0}, {"n": 1, "type": "Summary"}, {"v": 9.0}, {"n": 2, "type": "Summary"}))]
    for order in (rows, rows[::-1]):
        got = [(e.t_ms, e.kind, e.service_name) for e in M.metric_events(points(spark, order), F_M).collect()]
        assert got == [(1000, "restart", "b"), (2000, "restart", "a")]


def test_group_keys(spark):
    df = points(spark, [{"ms": 0}])
    assert [M.group_key(df, k)[0] for k in ("service_name", "res:" + M.POD, "attr:k", "k")] == ["service_name", "res:" + M.POD, "k", "k"]
    row = df.select(*[M.group_key(df, k)[1] for k in ("service_name", "res:" + M.POD, "attr:k", "missing")]).head()
    assert tuple(row) == ("s", "p", "v", "")


def test_dashboards(spark):
    cat = spark.createDataFrame([("http.server.duration", "Histogram", "ms"), ("jvm.memory.used", "Sum", "By"), ("own.metric", "Gauge", "1")],
                                "metric_name string, metric_type string, metric_unit string")
    got = [(r.panel, r.metric_name, r.variant) for r in P.resolve_dashboard(cat).collect()]
    assert got == [("http_server_rate", "http.server.duration", 1), ("http_server_latency", "http.server.duration", 1), ("http_route_rate", "http.server.duration", 1),
                   ("http_route_p95", "http.server.duration", 1), ("jvm_memory", "jvm.memory.used", 0)]
    assert [r.metric_name for r in P.uncovered_metrics(cat).collect()] == ["own.metric"]
    assert len(P.PANELS) == 6 and sum(len(s) for s in P.PANELS.values()) == 24


def test_error_labels(spark):
    df = spark.createDataFrame([("500",), (" 503 ",), ("5000",), ("STATUS_CODE_ERROR",), ("200",)], "v string")
    assert [r[0] for r in df.select(M.is_error_label(F.col("v"))).collect()] == [True, True, False, True, False]


def test_spikes(spark):
    pts = spark.createDataFrame([(3, ["api", "/x", "", "STATUS_CODE_ERROR", "pod-1"], 2.5)], "bucket long, keys array<string>, v double")
    r = P.spikes_from_series(pts, B, ("service_name", "http.route", "db.system", "status.code", "res:k8s.pod.name"), "s", "quantile").head()
    assert (r.service_name, r.t_ms, r.error_only, r.min_ms) == ("api", 300_000, True, 2500.0)
    assert [tuple(x) for x in r.attrs] == [("http.route", "/x")] and [tuple(x) for x in r.log_dims] == [("pod", "pod-1")]


def test_all_exemplars_by_default(spark):
    one = F.struct(F.col("timestamp").alias("timestamp"), F.col("v").alias("value"), F.lit("t").alias("trace_id"), F.lit("s").alias("span_id"))
    df = points(spark, [{"ms": 0, "v": 1.0}]).withColumn("v", F.lit(1.0)).withColumn("exemplars", F.array_repeat(one, 600))
    assert M.exemplars(df, F_M).count() == 600 and M.exemplars(df, F_M, 100).count() == 100
