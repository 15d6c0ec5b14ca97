"""Following a log: newest screen first, then increments, late lines included once.

``readStream`` brings new lines, a one-minute watermark keeps lines that arrive late,
and lines seen before are dropped within that minute.  Progress lives in the
checkpoint, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from telespark.functions.timeaxis import instant
from telespark.operators.logs import LogFilter, log_columns, search_logs

# Fixed values of log following.
POLL = "1 second"
LATE = "60 seconds"
RESUME_MS = 5 * 60_000
FULL_BATCHES = 10
FINGERPRINT = ("timestamp", "host", "file", "thread", "logger", "message")


def prime(logs: DataFrame, f: LogFilter, screen: int = 200) -> DataFrame:
    """The first screen: the newest matching lines, oldest first."""
    return search_logs(logs, f, "desc", screen).orderBy("ts_ms")


def resume_from(cursor_ms: int | None, now_ms: int) -> int | None:
    """Where to continue: the cursor if it is at most five minutes old, else nowhere
    (start over with a fresh screen)."""
    return cursor_ms if cursor_ms is not None and 0 <= now_ms - cursor_ms <= RESUME_MS else None


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = FULL_BATCHES) -> DataFrame:
    """New files under ``path``; ``files_per_trigger`` bounds one batch of catching up."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tail_logs(stream: DataFrame, f: LogFilter, cursor_ms: int | None = None, late: str = LATE) -> DataFrame:
    """Matching new lines, each once.  Works on a streaming and on a static DataFrame.

    The message takes part in the identity of a line as two hashes, so the kept state
    is a few bytes per line however long the lines are."""
    rows = stream
    if cursor_ms is not None:
        # a minute behind the cursor is read again for lines that arrived late
        rows = rows.where(F.col("timestamp") >= instant(max(0, cursor_ms - 60_000)))
    for c in replace(f, range=None).clauses(rows).values():
        rows = rows.where(c)
    prints = rows.withColumns({"__m1": F.xxhash64("message"), "__m2": F.xxhash64(F.lit(1), "message")})
    identity = [c for c in FINGERPRINT if c != "message"] + ["__m1", "__m2"]
    if stream.isStreaming:
        once = prints.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(identity)
    else:
        once = prints.dropDuplicates(identity)
    return once.drop("__m1", "__m2")


def start_tail(stream: DataFrame, f: LogFilter, sink, checkpoint: str, cursor_ms: int | None = None, poll: str = POLL,
               once: bool = False, cap: int | None = None) -> StreamingQuery:
    """Run the follow query.  ``sink(rows, batch_id)`` gets each increment, oldest first;
    ``once`` drains what is there and stops."""
    rows = log_columns(tail_logs(stream, f, cursor_ms), cap)

    def deliver(batch: DataFrame, batch_id: int) -> None:
        sink(batch.orderBy("ts_ms"), batch_id)

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(deliver)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)
    return writer.start()


def drain(query: StreamingQuery, timeout_s: float = 120.0) -> None:
    """Wait for an ``availableNow`` query to finish; its own error is raised."""
    end = time.time() + timeout_s
    while query.isActive and time.time() < end:
        query.awaitTermination(1)
    if query.isActive:
        query.stop()
        raise TimeoutError("the follow query did not finish in time")
    if query.exception() is not None:
        raise query.exception()
