import numpy as np
import pytest
from pyspark.sql import functions as F

from telespark.functions.timeaxis import Bucket, TimeRange
from telespark.operators import logs, toplists, traces

T0 = 1_700_000_000_000 // 86_400_000 * 86_400_000
MIN = 60_000
DAY = TimeRange(T0, T0 + 1440 * MIN)


def lines(spark, n=4000, values=40):
    rng = np.random.default_rng(4)
    rows = [(T0 + int(t), f"h{min(int(h), values - 1)}", "ERROR" if t % 3 else "INFO", f"m{i}") for i, (t, h) in enumerate(zip(rng.integers(0, 1440 * MIN, n), rng.geometric(0.05, n)))]
    df = spark.createDataFrame(rows, "ms long, host string, level string, message string")
    return df.select(F.timestamp_millis("ms").alias("timestamp"), "level", F.lit("").alias("trace_id"), F.lit("").alias("span_id"), F.lit("t").alias("thread"),
                     F.lit("l").alias("logger"), "message", F.lit("f").alias("file"), "host", F.when(F.col("level") == "INFO", "x").alias("pod"))


def test_facets_of_states_are_those_of_one_pass(spark):
    df, hours = lines(spark), Bucket(60 * MIN, T0)
    states = toplists.facet_states(df, logs.LogFilter(DAY), ("host", "level", "pod"), hours)
    some = TimeRange(T0 + 120 * MIN, T0 + 720 * MIN)
    got = toplists.facets(states, 5, some, hours)
    want = logs.log_facets(df.fillna("", ["pod"]), logs.LogFilter(some), ("host", "level", "pod"), 5)
    assert sorted(map(tuple, got.drop("error").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        toplists.facets(states, 5, TimeRange(T0 + 1, T0 + 60 * MIN), hours)
    assert toplists.facets(states.where("false"), 5).count() == 0


def test_facets_with_too_many_values_keep_their_bound(spark):
    df, hours, tracked = lines(spark, 6000, 10 ** 6).withColumn("host", F.expr("if(crc32(message) % 4 = 0, host, message)")), Bucket(60 * MIN, T0), 48
    got = toplists.facets(toplists.facet_states(df, logs.LogFilter(DAY), ("host",), hours, tracked), 3, tracked=tracked).collect()
    exact = {r.value: r["count"] for r in logs.log_facets(df, logs.LogFilter(DAY), ("host",)).collect()}
    for r in got:
        assert 0 < r.error < 6000 and abs(exact.get(r.value, 0) - r["count"]) <= r.error


def test_newest_logs_read_a_fraction(spark):
    df, read = lines(spark), []
    f = logs.LogFilter(DAY, levels=("ERROR",))
    for limit, offset in ((5, 0), (20, 7), (300, 0)):
        read.clear()
        got = toplists.newest_logs(df, f, limit, offset, seen=lambda part, n: read.append(part)).collect()
        assert got == logs.search_logs(df, f, "desc", limit, offset).collect()
        covered = TimeRange(read[-1].from_ms, DAY.to_ms)
        assert df.where(covered.holds()).count() < df.count() / 2 and all(a.from_ms == b.to_ms for a, b in zip(read, read[1:]))
    none = toplists.newest_logs(df, logs.LogFilter(DAY, levels=("NONE",)), 5, seen=lambda part, n: read.append(part))
    assert none.count() == 0 and read[-1].from_ms == DAY.from_ms
    assert sum(p.span_ms for p in toplists.newest_slices(DAY)) == DAY.span_ms


def test_newest_traces_are_the_candidates(spark):
    rng = np.random.default_rng(9)
    rows = [(T0 + int(t), f"t{int(k)}", "Server", "s" if k % 2 else "q") for t, k in zip(rng.integers(0, 1440 * MIN, 3000), rng.integers(0, 500, 3000))]
    df = spark.createDataFrame(rows, "ms long, trace_id string, span_kind string, service_name string").withColumn("timestamp", F.timestamp_millis("ms")).drop("ms") \
        .withColumns({"duration_ns": F.lit(1), "status_code": F.lit("Unset"), "span_name": F.lit("o")})
    f = traces.SpanFilter(DAY, service="s")
    for n in (1, 40, 900):
        got = toplists.newest_traces(df, f, n).collect()
        assert [tuple(r) for r in got] == [(r.trace_id, r.ts_ms) for r in traces.candidate_traces(df, f, "time", n).collect()]
