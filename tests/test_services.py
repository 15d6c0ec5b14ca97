from pyspark.sql import functions as F

from telespark.functions.maths import change, change_pct, ratio
from telespark.functions.timeaxis import HOUR, Bucket, TimeRange
from telespark.operators import services as S

T0 = 1_700_006_400_000       # a full hour
NOW = TimeRange(T0, T0 + HOUR)


def spans(spark, rows):
    """(service, operation, offset ms, count, duration ms, errors)"""
    df = spark.createDataFrame(rows, "service_name string, span_name string, off long, n int, dur int, bad int")
    return df.select("service_name", "span_name", F.lit("Server").alias("span_kind"), F.lit("c").alias("cluster"), F.explode(F.sequence(F.lit(1), "n")).alias("i"),
                     "off", "dur", "bad").select(
        "service_name", "span_name", "span_kind", "cluster", F.timestamp_millis(F.lit(T0) + F.col("off")).alias("timestamp"),
        (F.col("dur") * 1_000_000).cast("long").alias("duration_ns"), F.when(F.col("i") <= F.col("bad"), "Error").otherwise("Unset").alias("status_code"))


def test_change_conventions(spark):
    df = spark.createDataFrame([(5.0, None), (0.0, 0.0), (3.0, 0.0), (3.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(change(a, b)).collect()] == [None, 0.0, float("inf"), 0.5]
    assert [tuple(r) for r in df.select(change_pct(a, b), ratio(a, b)).collect()] == [(None, None)] * 3 + [(50.0, 1.5)]


def test_totals_and_buckets_in_one_pass(spark):
    df = spans(spark, [("a", "x", 0, 10, 5, 1), ("a", "x", 1_800_000, 30, 15, 0)])
    rows = S.service_stats(df, NOW, Bucket(1_800_000, T0)).collect()
    total = next(r for r in rows if r.is_total == 1)
    assert (total.requests, total.errors, total.p50_ms, total.max_ms, total.bucket) == (40, 1, 15.0, 15.0, None)
    assert sorted((r.bucket, r.requests) for r in rows if r.is_total == 0) == [(0, 10), (1, 30)]


def test_new_gone_and_capped(spark):
    rows = [("a", "kept", 0, 5, 1, 0), ("a", "kept", -HOUR, 4, 1, 0), ("a", "fresh", 0, 3, 1, 0), ("a", "lost", -HOUR, 9, 1, 2)]
    got = {r.span_name: r for r in S.compare_operations(spans(spark, rows), NOW, "prev").collect()}
    assert {k: v.status for k, v in got.items()} == {"kept": None, "fresh": "new", "lost": "gone"}
    assert (got["lost"].requests, got["lost"].prev_requests, got["lost"].prev_error_rate, got["kept"].prev_requests) == (0, 9, 2 / 9, 4)
    capped = S.compare_operations(spans(spark, rows), NOW, "prev", per_service=2)
    assert {r.span_name: r.truncated for r in capped.collect()} == {"kept": True, "fresh": True}
    alone = S.compare_operations(spans(spark, rows), NOW, "none")
    assert {r.span_name for r in alone.collect()} == {"kept", "fresh"} and alone.where("status is not null").count() == 0


def overview(spark, **kw):
    base = dict(service_name="s", requests=1000, errors=0, error_rate=0.0, p95_ms=100.0, prev_requests=1000, prev_errors=0, prev_p95_ms=100.0)
    row = {**base, **kw}
    return spark.createDataFrame([tuple(row.values())], "service_name string, requests long, errors long, error_rate double, p95_ms double, "
                                 "prev_requests long, prev_errors long, prev_p95_ms double")


def level(spark, rate=S.STARTED_ERRORING_RATE, **kw):
    r = S.service_health(overview(spark, **kw), rate).head()
    return r.health, r.reasons


def test_health_thresholds(spark):
    assert level(spark) == ("ok", [])
    assert level(spark, error_rate=0.05, errors=50, prev_errors=1) == ("bad", ["error_rate"])
    assert level(spark, error_rate=0.01, errors=10, prev_errors=1) == ("warn", ["error_rate"])
    assert level(spark, p95_ms=300.0) == ("bad", ["p95_ratio"])
    assert level(spark, p95_ms=220.0) == ("warn", ["p95_ratio"])
    assert level(spark, p95_ms=199.0, prev_p95_ms=10.0) == ("ok", [])                    # too short to matter
    assert level(spark, p95_ms=900.0, prev_requests=299) == ("ok", [])                   # too few to tell
    assert level(spark, errors=2, error_rate=0.002) == ("warn", ["started_erroring"])
    assert level(spark, errors=1, error_rate=0.001) == ("ok", [])
    assert level(spark, rate=0.0, errors=1, error_rate=0.001) == ("warn", ["started_erroring"])
    assert level(spark, prev_requests=None, prev_errors=None, prev_p95_ms=None) == ("ok", [])


def test_movers(spark):
    rows = [("a", "slow", 0, 200, 400, 0), ("a", "slow", -HOUR, 200, 100, 0), ("a", "errs", 0, 200, 10, 20), ("a", "errs", -HOUR, 200, 10, 1),
            ("a", "gone", -HOUR, 150, 10, 0), ("a", "new", 0, 150, 10, 0), ("a", "busy", 0, 400, 10, 0), ("a", "busy", -HOUR, 200, 10, 0),
            ("a", "better", 0, 200, 10, 0), ("a", "better", -HOUR, 200, 500, 0), ("a", "tiny", 0, 20, 900, 0), ("a", "tiny", -HOUR, 20, 1, 0)]
    ops = S.compare_operations(spans(spark, rows), NOW, "prev")
    got = [(r.span_name, r.mover, r.better) for r in S.operation_movers(ops, None).orderBy("place").collect()]
    assert got == [("gone", "gone", False), ("errs", "errors", False), ("slow", "latency", False), ("new", "new", False),
                   ("busy", "traffic", False), ("better", "latency", True)]
    hot = S.latency_hotspot(ops, NOW.span_ms).collect()
    assert [] == hot                                   # 60 s extra is under 2 % of an hour
    assert S.latency_hotspot(ops, 1_000_000).head().span_name == "slow"
    assert S.main_contributor(ops, NOW.span_ms).head().span_name == "gone"
    assert S.main_contributor(ops, 1_000_000).head().span_name == "gone"


def test_contributor_without_movers(spark):
    ops = S.compare_operations(spans(spark, [("a", "x", 0, 40, 5, 0), ("a", "x", -HOUR, 40, 5, 0), ("a", "y", 0, 29, 50, 0), ("a", "y", -HOUR, 29, 50, 0)]), NOW, "prev")
    r = S.main_contributor(ops, NOW.span_ms).head()
    assert (r.span_name, r.mover) == ("x", "slowest")


def test_sparklines(spark):
    o = S.service_overview(spans(spark, [("a", "x", 0, 2, 1, 1), ("a", "x", 130_000, 3, 1, 0), ("a", "x", -HOUR + 130_000, 5, 1, 0)]), NOW, "prev").head()
    assert len(o.spark_requests) == 30 and o.spark_requests[:2] == [2, 3] and o.spark_errors[0] == 1 and o.spark_prev_requests[1] == 5
    assert (o.requests, o.prev_requests, o.rps) == (5, 5, 5 / 3600)


def test_site(spark):
    df = spans(spark, [("a", "x", 0, 10, 1, 5), ("b", "x", 0, 30, 1, 0), ("a", "x", -HOUR, 20, 1, 0)])
    h = S.service_health(S.service_overview(df, NOW, "prev"))
    s = S.site_overview(h, NOW, "prev").head()
    assert (s.requests, s.unhealthy, s.services, s.error_rate_change, s.rps_change, s.restarts) == (40, 1, 2, float("inf"), 1.0, 0)


def test_all_movers_by_default(spark):
    ops = S.compare_operations(spans(spark, [("a", f"new{i}", 0, 150, 10, 0) for i in range(9)] + [("a", "old", -HOUR, 1, 10, 0)]), NOW, "prev")
    assert S.operation_movers(ops).count() == 9 and S.operation_movers(ops, 6).count() == 6
