"""Counter restarts, log histograms and service figures that follow a stream.

Each is the batch operator of the same name over rows that arrive in files, late ones included as long as they are no
later than ``late``. What an operator knows lives in the checkpoint, so a query that is stopped goes on where it was.
Results are final: a restart, a bucket or a window is given once, when no earlier row can arrive any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from telespark.functions.timeaxis import Bucket
from telespark.operators import metrics, rollups
from telespark.operators.logs import LogFilter, level_rank
from telespark.operators.traces import ENTRY_KINDS

LATE = "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _window(bucket: Bucket) -> Column:
    return F.window("timestamp", f"{bucket.width_ms} milliseconds", startTime=f"{bucket.origin_ms % bucket.width_ms} milliseconds")


def _number(bucket: Bucket, window: str = "window") -> Column:
    return F.floor((F.unix_millis(F.col(f"{window}.start")) - F.lit(bucket.origin_ms)) / F.lit(bucket.width_ms)).alias("bucket")


# --- counters ------------------------------------------------------------------------------------

def _falls(idle_ms: int | None) -> StatefulProcessor:
    """State of one counter: its last sample, and the samples that an earlier one may still precede.

    Defined here so that it travels to the workers by value."""
    import pandas as pd

    class Falls(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "at long, v double")
            self.waiting = handle.getListState("waiting", "at long, v double")
            self.handle = handle

        def settle(self, key, fresh, timers):
            sure = timers.getCurrentWatermarkInMs() * 1000
            samples = [*(self.waiting.get() if self.waiting.exists() else ()), *fresh]
            samples.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0.0))
            done = [x for x in samples if x[0] <= sure]
            rest = samples[len(done):]
            before = self.last.get() if self.last.exists() else None
            hits = []
            for sample in done:
                known = before is not None and (idle_ms is None or sample[0] - before[0] <= 1000 * idle_ms)
                if known and before[1] is not None and sample[1] is not None and sample[1] < before[1] and before[1] > 0:
                    hits.append(sample[0] // 1000)
                before = sample
            if done:
                self.last.update(tuple(done[-1]))
            if rest:
                self.waiting.put([tuple(x) for x in rest])
                self.handle.registerTimer(-(-rest[0][0] // 1000))
            else:
                self.waiting.clear()
            if idle_ms is not None and samples:
                self.handle.registerTimer(samples[-1][0] // 1000 + idle_ms + 1)
            if hits:
                yield pd.DataFrame({"t_ms": hits, "pod": [key[1]] * len(hits), "service_name": [key[0]] * len(hits)})

        def handleInputRows(self, key, rows, timerValues):
            fresh = [(int(a), None if pd.isna(v) else float(v)) for part in rows for a, v in zip(part["at"], part["v"])]
            yield from self.settle(key, fresh, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield from self.settle(key, [], timerValues)
            # samples that wait are later than the watermark
            if idle_ms is not None and self.last.exists() and self.last.get()[0] // 1000 + idle_ms < timerValues.getCurrentWatermarkInMs():
                self.last.clear()

        def close(self) -> None:
            pass

    return Falls()


def counter_restarts(points: DataFrame, f: metrics.MetricFilter, field: str | None = "value", late: str = LATE, idle_ms: int | None = None) -> DataFrame:
    """``t_ms, pod, service_name`` of each fall of a counter, once the watermark has passed it.

    Samples are kept until then and looked at in the order of time, so it does not matter in which order they
    came. A counter silent for longer than ``idle_ms`` starts anew; None keeps the last sample of each. Needs RocksDB state."""
    rows = metrics.watched(points.withWatermark("timestamp", late), f, field).withColumn("at", F.unix_micros("timestamp"))
    return rows.groupBy("service_name", "pod", "watched").transformWithStateInPandas(
        _falls(idle_ms), "t_ms long, pod string, service_name string", "Append", "EventTime")


# --- log lines -----------------------------------------------------------------------------------

def _gaps(first: int, levels: tuple[str, ...]) -> StatefulProcessor:
    """State: the last bucket given. Closed buckets come as counts, a few rows each; those between get zeros."""
    import pandas as pd

    class Gaps(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "bucket long")

        def handleInputRows(self, key, rows, timerValues):
            closed = pd.concat(list(rows))
            start = self.last.get()[0] + 1 if self.last.exists() else first
            end = int(closed["bucket"].max())
            seen = {(int(b), level): int(n) for b, level, n in zip(closed["bucket"], closed["level"], closed["count"])}
            cells = [(b, level, seen.pop((b, level), 0)) for b in range(start, end + 1) for level in levels]
            cells += [(b, level, n) for (b, level), n in sorted(seen.items(), key=str)]          # levels not declared
            self.last.update((max(end, start - 1),))
            yield pd.DataFrame(cells, columns=["bucket", "level", "count"])

        def close(self) -> None:
            pass

    return Gaps()


def log_histogram(lines: DataFrame, f: LogFilter, bucket: Bucket, levels: tuple[str, ...], late: str = LATE) -> DataFrame:
    """``t_ms, level, level_rank, count`` of each bucket of the range that is closed, with a zero for every declared level.

    Buckets start with the first one of the range; empty ones are given with the next closed one that has lines."""
    if f.range is None:
        raise ValueError("a histogram needs a time range")
    counts = f.apply(lines.withWatermark("timestamp", late)).groupBy(_window(bucket), "level").agg(F.count("*").alias("count"))
    cells = counts.select(F.lit(0).alias("all"), _number(bucket), "level", "count").groupBy("all").transformWithStateInPandas(
        _gaps(bucket.first(f.range), tuple(levels)), "bucket long, level string, count long", "Append", "None")
    return cells.select(bucket.start(F.col("bucket")).alias("t_ms"), "level", level_rank(F.col("level")).alias("level_rank"), "count")


# --- services ------------------------------------------------------------------------------------

def service_states(spans: DataFrame, bucket: Bucket, late: str = LATE, k: int = rollups.ACCURACY, by=("service_name",)) -> DataFrame:
    """One mergeable state for each closed bucket and service: ``rollups.stats`` answers from the table they are written to."""
    rows = spans.withWatermark("timestamp", late).where(F.col("span_kind").isin(list(ENTRY_KINDS)))
    return rows.groupBy(*by, _window(bucket)).agg(*rollups.states(k)).select(*by, _number(bucket), "requests", "errors", "total_ns", "max_ns", "sketch")


# --- running -------------------------------------------------------------------------------------

def start(rows: DataFrame, out: str, checkpoint: str, once: bool = False, poll: str = "10 seconds", rocks: bool = False) -> StreamingQuery:
    """Append the results to the Parquet table ``out``, each once; ``once`` drains what is there and stops.

    ``rocks``: keep state in RocksDB, which counter restarts and log histograms need; it takes some megabytes of disk for each partition of the state."""
    conf, key = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    if rocks:
        conf.set(key, ROCKS)
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()
    finally:
        conf.set(key, before)           # a query keeps the settings it was started with
