"""Streams that must give what the batch operators give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespark.functions.timeaxis import Bucket, TimeRange
from telespark.operators import logs, metrics, rollups, services
from telespark.streaming import rolling, tail

T0 = 1_700_000_000_000 // 86_400_000 * 86_400_000
DAY = TimeRange(T0, T0 + 86_400_000)
MIN = 60_000


def points(spark, rows):
    df = spark.createDataFrame([(T0 + ms, float(v) if v is not None else None, pod, svc) for ms, v, pod, svc in rows], "ms long, v double, pod string, service_name string")
    return df.select(F.timestamp_millis("ms").alias("timestamp"), F.lit("requests").alias("metric_name"), F.lit("Sum").alias("metric_type"),
                     "service_name", F.create_map(F.lit("k8s.pod.name"), "pod").alias("resource_attributes"), F.col("v").alias("value"), F.lit(0).cast("long").alias("count"))


def stream(spark, folder, rows_of, make, batches, rocks=False):
    """Deliver the batches one after the other, each to a query started anew from the checkpoint; all results."""
    src, out, state = (str(folder / x) for x in ("in", "out", "state"))
    for rows in batches:
        rows_of(rows).coalesce(1).write.mode("append").parquet(src)
        lines = tail.read_stream(spark, src, rows_of(rows).schema)
        tail.drain(rolling.start(make(lines), out, state, once=True, rocks=rocks), 300)
    return spark.read.parquet(out)


def test_restarts_with_late_points_and_a_resume(spark, tmp_path):
    f = metrics.MetricFilter(DAY, "requests")
    batches = [[(0, 5, "a", "s"), (2 * MIN, 9, "a", "s"), (3 * MIN, 1, "b", "s"), (9 * MIN, 4, "a", "t")],
               # a late point of a is a fall that the points before did not show; b falls only between the batches
               [(1 * MIN, 2, "a", "s"), (20 * MIN, 0, "b", "s"), (21 * MIN, 4, "a", "t"), (30 * MIN, 1, "a", "s")],
               [(50 * MIN, 3, "a", "t"), (55 * MIN, None, "a", "s"), (60 * MIN, 0.5, "a", "s"), (55 * MIN, 0, "b", "s")],
               [(2 * MIN, 100, "a", "s"), (300 * MIN, 1, "z", "z")]]                        # far too late: not looked at
    rows = [r for b in batches for r in b if r[:2] != (2 * MIN, 100)]
    want = sorted(map(tuple, metrics.counter_restarts(points(spark, rows), f).collect()))
    got = stream(spark, tmp_path, lambda r: points(spark, r), lambda s: rolling.counter_restarts(s, f, late="10 minutes"), batches, rocks=True)
    assert sorted(map(tuple, got.select("t_ms", "pod", "service_name").collect())) == want
    assert [(t - T0) // MIN for t, _, _ in want] == [1, 20, 30, 50]


def test_a_silent_counter_is_forgotten(spark, tmp_path):
    f = metrics.MetricFilter(DAY, "requests")
    batches = [[(0, 5, "a", "s"), (0, 5, "b", "s")], [(40 * MIN, 1, "b", "s")], [(200 * MIN, 1, "a", "s")], [(400 * MIN, 1, "z", "z")]]
    got = stream(spark, tmp_path, lambda r: points(spark, r), lambda s: rolling.counter_restarts(s, f, late="1 minute", idle_ms=60 * MIN), batches, rocks=True)
    assert [(r.t_ms - T0, r.pod) for r in got.collect()] == [(40 * MIN, "b")]


def lines(spark, rows):
    df = spark.createDataFrame([(T0 + ms, level, f"m{i}") for i, (ms, level) in enumerate(rows)], "ms long, level string, message string")
    return df.select(F.timestamp_millis("ms").alias("timestamp"), "level", F.lit("").alias("trace_id"), F.lit("").alias("span_id"), F.lit("t").alias("thread"),
                     F.lit("l").alias("logger"), "message", F.lit("f").alias("file"), F.lit("h").alias("host"))


def test_histogram_closes_buckets_and_fills_gaps(spark, tmp_path):
    f = logs.LogFilter(DAY)
    bucket = Bucket(10 * MIN, T0)
    batches = [[(1 * MIN, "ERROR"), (2 * MIN, "INFO"), (12 * MIN, "INFO")],
               [(9 * MIN, "ERROR"), (15 * MIN, "ODD"), (16 * MIN, "INFO"), (70 * MIN, "ERROR")],       # 9: late, inside the watermark
               [(3 * MIN, "ERROR"), (100 * MIN, "INFO")],                                              # 3: too late
               [(200 * MIN, "INFO")]]
    got = stream(spark, tmp_path, lambda r: lines(spark, r), lambda s: rolling.log_histogram(s, f, bucket, ("ERROR", "INFO"), late="5 minutes"), batches, rocks=True)
    cells = {((r.t_ms - T0) // MIN, r.level): r["count"] for r in got.collect()}
    assert cells.pop((10, "ODD")) == 1
    some = {(0, "ERROR"): 2, (0, "INFO"): 1, (10, "INFO"): 2, (70, "ERROR"): 1, (100, "INFO"): 1}
    assert cells == {(b, level): some.get((b, level), 0) for b in range(0, 110, 10) for level in ("ERROR", "INFO")}
    assert got.count() == len(cells) + 1


def spans(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(T0 + int(t), f"s{int(k) % 3}", f"op{int(k) % 5}", "Server" if k % 4 else "Client", int(d), "Error" if k % 7 == 0 else "Unset")
            for t, k, d in zip(np.sort(rng.integers(0, 6 * 60 * MIN, n)), rng.integers(0, 1000, n), rng.lognormal(15, 2, n))]
    df = spark.createDataFrame(rows, "ms long, service_name string, span_name string, span_kind string, duration_ns long, status_code string")
    return df.withColumn("timestamp", F.timestamp_millis("ms")).drop("ms")


def test_service_states_of_closed_windows(spark, tmp_path):
    bucket, all_spans = Bucket(60 * MIN, T0), spans(spark, 3000)
    cut = F.floor(F.unix_millis("timestamp") / (60 * MIN)) - T0 // (60 * MIN)
    batches = [all_spans.where(cut.between(0, 2)), all_spans.where(cut.between(3, 5)), spans(spark, 1).withColumn("timestamp", F.timestamp_millis(F.lit(T0 + 20 * 60 * MIN)))]
    states = stream(spark, tmp_path, lambda r: r, lambda s: rolling.service_states(s, bucket, k=4096), batches)
    six = TimeRange(T0, T0 + 6 * 60 * MIN)
    got = rollups.stats(states, six, bucket)
    want = services.service_stats(all_spans, six, bucket)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_states_merge_to_what_one_pass_gives(spark):
    bucket, df = Bucket(30 * MIN, T0), spans(spark, 6000)
    now, small = TimeRange(T0 + 3 * 60 * MIN, T0 + 6 * 60 * MIN), 200
    states = rollups.span_rollup(df, bucket, k=small).cache()
    assert [r[:3] + r[3:] for r in sorted(map(tuple, rollups.stats(states, now, bucket).select("service_name", "is_total", "bucket", "requests", "errors", "max_ms").collect()), key=str)] == \
        sorted(map(tuple, services.service_stats(df, now, bucket).select("service_name", "is_total", "bucket", "requests", "errors", "max_ms").collect()), key=str)
    # rank error of merged sketches
    got = {r.service_name: r for r in rollups.stats(states, now, bucket).where("is_total = 1").collect()}
    for name, r in got.items():
        d = np.sort([x.duration_ns / 1e6 for x in df.where(now.holds() & (F.col("service_name") == name) & F.col("span_kind").isin("Server", "Consumer")).collect()])
        for q, v in ((0.5, r.p50_ms), (0.95, r.p95_ms), (0.99, r.p99_ms)):
            assert abs(np.searchsorted(d, v) / len(d) - q) < 0.02
    both = {(r.service_name, r.span_name): r for r in rollups.compare(states, now, bucket, "prev").collect() if r.span_kind == "Server"}
    before = now.shift(-now.span_ms)
    for rng, pre in ((now, ""), (before, "prev_")):
        for r in df.where(rng.holds() & (F.col("span_kind") == "Server")).groupBy("service_name", "span_name").agg(F.count("*").alias("n"), F.max("duration_ns").alias("m")).collect():
            assert both[r.service_name, r.span_name][pre + "requests"] == r.n and abs(both[r.service_name, r.span_name][pre + "max_ms"] - r.m / 1e6) < 1e-9
    with pytest.raises(ValueError):
        rollups.stats(states, TimeRange(T0 + 1, T0 + 30 * MIN), bucket)
    assert rollups.operations(states.where("false"), now, bucket).count() == 0
