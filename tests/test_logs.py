import pytest
from pyspark.sql import functions as F

from telespark.functions.timeaxis import HOUR, TimeRange
from telespark.operators import logs as L

T0 = 1_700_000_000_000
SCHEMA = ("timestamp timestamp, level string, trace_id string, span_id string, thread string, logger string, message string, "
          "file string, host string, service_name string, pod string, n int")


def logs(spark, rows):
    full = [(r.get("ms", T0), r.get("level", "INFO"), r.get("trace", ""), "", "main", r.get("logger", "app"), r.get("message", "m"),
             r.get("file", "f"), r.get("host", "h"), r.get("service", "s"), r.get("pod", "p"), 1) for r in rows]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame(full, SCHEMA.replace("timestamp timestamp", "timestamp long"))
    return df.withColumn("timestamp", F.timestamp_millis("timestamp")).select(*names)


RANGE = TimeRange(T0, T0 + HOUR)


def test_histogram_is_dense_and_adds_up(spark):
    df = logs(spark, [{"ms": T0 + i * 60_000, "level": "ERROR" if i % 3 else "INFO"} for i in range(30)] + [{"ms": T0 + HOUR}])
    h = L.log_histogram(df, L.LogFilter(RANGE))
    # a range that starts inside a bucket touches one bucket more
    assert h.select("t_ms").distinct().count() in (120, 121) and h.agg(F.sum("count")).head()[0] == 30
    assert {(r.level, r.level_rank) for r in h.collect()} == {("ERROR", 1), ("INFO", 4)}
    assert L.histogram_total(h).head()[0] == 30


def test_truncation_happens_after_filtering(spark):
    df = logs(spark, [{"message": "é" * 50 + " needle"}])
    row = L.search_logs(df, L.LogFilter(RANGE, q="needle"), cap=10).head()
    assert row.message == "é" * 10 and row.message_len == 57
    assert L.export_logs(df, L.LogFilter(RANGE)).head().message.endswith("needle")


def test_guards(spark):
    df = logs(spark, [{}])
    with pytest.raises(ValueError):
        L.search_logs(df, L.LogFilter())
    with pytest.raises(ValueError):
        L.search_logs(df, L.LogFilter(RANGE), offset=10_001)
    with pytest.raises(ValueError):
        L.search_logs(df, L.LogFilter(RANGE, dims={"nope": ("x",)}))
    with pytest.raises(ValueError):
        L.log_facets(df, L.LogFilter(RANGE), ["message"])
    assert L.search_logs(df, L.LogFilter(trace_id="")).count() == 1


def test_context_counts_the_whole_millisecond(spark):
    df = logs(spark, [{"ms": T0 + d, "message": str(d)} for d in (-2 * HOUR, -2, -1, 0, 0, 1, 2, 2 * HOUR)])
    rows = L.log_context(df, "h", "f", T0, n=3).collect()
    assert sorted((r.side, int(r.message)) for r in rows) == [("after", 1), ("after", 2), ("before", -1), ("before", 0), ("before", 0)]


def test_batch_context_equals_single(spark):
    df = logs(spark, [{"ms": T0 + i * 70_000, "trace": f"t{i:03d}", "host": f"h{i % 2}"} for i in range(200)])
    anchors = spark.createDataFrame([("a", "h0", "f", T0 + 5_000_000), ("b", "h1", "f", T0), ("c", "h1", "f", T0 + 13_900_000)],
                                    "anchor_id string, host string, file string, ts_ms long")
    got = {(r.anchor_id, r.side, r.trace_id) for r in L.log_context_batch(df, anchors, n=4).collect()}
    want = set()
    for a in anchors.collect():
        want |= {(a.anchor_id, r.side, r.trace_id) for r in L.log_context(df, a.host, a.file, a.ts_ms, 4).collect()}
    assert got == want and len(got) > 12


def test_highlights():
    f = L.LogFilter(RANGE, q="pay -late 1234567890")
    assert f.highlights() == {"terms": ["pay", "1234567890"], "token_terms": ["1234567890"]}
    scoped = L.LogFilter(RANGE, q="1234567890", dims={"service_name": ("s",)})
    assert scoped.highlights()["token_terms"] == []


def test_shape(spark):
    row = L.shape_log_row(L.log_columns(logs(spark, [{"message": "x" * 30, "pod": ""}])), "Asia/Shanghai", 5).head()
    assert row.message.startswith("xxxxx…") and row.message_len == 30 and "pod" not in row.fields and row.time.startswith("2023-11-15 06:13:20")
