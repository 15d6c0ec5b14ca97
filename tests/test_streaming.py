from pyspark.sql import functions as F

from telespark.functions.timeaxis import TimeRange
from telespark.operators.logs import LogFilter
from telespark.streaming import tail

T0 = 1_700_000_000_000
SCHEMA = "timestamp timestamp, level string, trace_id string, span_id string, thread string, logger string, message string, file string, host string"


def batch(spark, rows):
    df = spark.createDataFrame([(T0 + ms, level, "", "", "t", "l", msg, "f", "h") for ms, level, msg in rows], SCHEMA.replace("timestamp timestamp", "timestamp long"))
    return df.withColumn("timestamp", F.timestamp_millis("timestamp")).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def test_follow_resumes_and_keeps_late_lines_once(spark, tmp_path):
    src, cp, seen = str(tmp_path / "in"), str(tmp_path / "cp"), []
    f = LogFilter(TimeRange(T0, T0 + 1000), levels=("ERROR",))

    def sink(rows, _):
        seen.append([(r.ts_ms - T0, r.message) for r in rows.collect()])

    def run():
        stream = tail.read_stream(spark, src, batch(spark, [(0, "ERROR", "x")]).schema)
        tail.drain(tail.start_tail(stream, f, sink, cp, once=True))

    batch(spark, [(0, "ERROR", "a"), (5_000, "INFO", "skip"), (100_000, "ERROR", "b")]).coalesce(1).write.parquet(src)
    run()
    assert sum(seen, []) == [(0, "a"), (100_000, "b")]
    # a repeat of b, a late line within the minute, one that is too late, and a new line
    batch(spark, [(100_000, "ERROR", "b"), (70_000, "ERROR", "late"), (1, "ERROR", "too late"), (110_000, "ERROR", "c")]).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(sum(seen, [])) == [(0, "a"), (70_000, "late"), (100_000, "b"), (110_000, "c")]
    for rows in seen:
        assert rows == sorted(rows)


def test_static_input_gives_each_line_once(spark):
    df = batch(spark, [(0, "ERROR", "a"), (0, "ERROR", "a"), (1, "ERROR", "a"), (0, "INFO", "a")])
    assert tail.tail_logs(df, LogFilter(levels=("ERROR",), trace_id=None)).count() == 2
    assert tail.tail_logs(df, LogFilter(), cursor_ms=T0 + 60_001).count() == 1          # a minute behind the cursor is read again


def test_prime_and_resume(spark):
    df = batch(spark, [(i, "INFO", str(i)) for i in range(10)])
    rows = tail.prime(df, LogFilter(TimeRange(T0, T0 + 100)), screen=3).collect()
    assert [r.message for r in rows] == ["7", "8", "9"]
    assert tail.resume_from(T0, T0 + 300_000) == T0 and tail.resume_from(T0, T0 + 300_001) is None and tail.resume_from(None, T0) is None
