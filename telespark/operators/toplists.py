"""Most frequent values from mergeable states, and newest rows found by probing.

Facets: a state per time slice and column keeps the most frequent values in bounded memory; states of a long range are
combined and no line is read again. A state that tracks at least as many values as a column has is exact; beyond that a
count is off by at most ``error``, which is given with it.

Probing: the newest rows of a long range are mostly found in its last minutes. Slices are read from the newest on, each
longer than the one before, until enough rows are sure; older slices are never opened. Each slice is read once, so
the worst case, too few matches, is one pass over the range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.functions.lineage import written
from telespark.functions.limits import at_most_per
from telespark.functions.timeaxis import MINUTE, Bucket, TimeRange, millis
from telespark.operators.logs import LogFilter, check_facets, log_columns, log_order
from telespark.operators.traces import SpanFilter

TRACKED = 10_000
PROBES = (MINUTE, 15 * MINUTE)      # the first slices; each later one is ``GROWTH`` times as long as the one before
GROWTH = 4


# --- facets --------------------------------------------------------------------------------------

def facet_states(logs: DataFrame, f: LogFilter, fields, bucket: Bucket, tracked: int = TRACKED) -> DataFrame:
    """``bucket, field, lines, state`` of many columns in one scan; NULL counts as ''."""
    fields = check_facets(logs, fields)
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(n), F.lit("")).alias("value")) for n in fields]))
    return f.apply(logs).select(bucket.index().alias("bucket"), pairs).groupBy("bucket", "field").agg(
        F.count("*").alias("lines"), F.expr(f"approx_top_k_accumulate(value, {int(tracked)})").alias("state"))


def facets(states: DataFrame, k: int | None = None, rng: TimeRange | None = None, bucket: Bucket | None = None, tracked: int = TRACKED) -> DataFrame:
    """``field, value, count, error`` of the range's slices: the top ``k`` values of each column, all that are tracked if None."""
    if rng is not None:
        if (rng.from_ms - bucket.origin_ms) % bucket.width_ms or (rng.to_ms - bucket.origin_ms) % bucket.width_ms:
            raise ValueError("the range must start and end on a border of the slices")
        states = states.where(F.col("bucket").between(bucket.first(rng), bucket.last(rng)))
    held = 1 << max(3, -(-4 * tracked // 3) - 1).bit_length()           # places of the sketch's table
    whole = states.groupBy("field").agg(F.sum("lines").alias("lines"), F.expr(f"approx_top_k_combine(state, {int(tracked)})").alias("state"))
    top = whole.select("field", F.floor(3.5 * F.col("lines") / held).alias("error"), F.expr(f"inline(approx_top_k_estimate(state, {int(tracked)}))"))
    return at_most_per(top.select("field", F.col("item").alias("value"), "count", "error"), ["field"], [F.desc("count"), F.asc("value")], k)


# --- newest first --------------------------------------------------------------------------------

def newest_slices(rng: TimeRange, steps=PROBES, growth: int = GROWTH) -> Iterator[TimeRange]:
    """Disjoint slices of the range, from the newest on, which together are the range."""
    end, width, steps = rng.to_ms, 0, list(steps)
    while end > rng.from_ms:
        width = steps.pop(0) if steps else width * growth
        start = max(rng.from_ms, end - width)
        yield TimeRange(start, end)
        end = start


def _probe(rng: TimeRange, n: int, found_in: Callable[[TimeRange, int, DataFrame | None], DataFrame], seen: Callable | None, steps, growth) -> DataFrame:
    parts, have = None, 0
    for part in newest_slices(rng, steps, growth):
        rows = found_in(part, n - have, parts)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(written(rows, "probe"))          # at most n rows
        have += rows.count()
        parts = rows if parts is None else parts.unionByName(rows)
        if seen:
            seen(part, have)
        if have >= n:
            break
    return parts


def newest_logs(logs: DataFrame, f: LogFilter, limit: int = 100, offset: int = 0, cap: int | None = None, seen: Callable | None = None,
                steps=PROBES, growth: int = GROWTH) -> DataFrame:
    """The rows of ``search_logs`` in descending order. ``seen(range, rows so far)`` is told of each slice read."""
    if f.range is None:
        raise ValueError("probing needs a time range")
    raw = _probe(f.range, limit + offset, lambda part, n, _: replace(f, range=part).apply(logs).orderBy(*log_order("desc")).limit(n), seen, steps, growth)
    rows = raw.orderBy(*log_order("desc"))
    return log_columns((rows.offset(offset) if offset else rows).limit(limit), cap)


def newest_traces(spans: DataFrame, f: SpanFilter, n: int = 50, seen: Callable | None = None, steps=PROBES, growth: int = GROWTH) -> DataFrame:
    """``trace_id, ts_ms`` of ``candidate_traces`` by time: a trace stands where its newest matching span is, so it is sure once seen."""
    f.validate()

    def found_in(part: TimeRange, left: int, before: DataFrame | None) -> DataFrame:
        hits = replace(f, range=part, unscoped_ms=None).apply(spans)
        if before is not None:
            hits = hits.join(before.select("trace_id"), "trace_id", "left_anti")
        return hits.groupBy("trace_id").agg(F.max(millis()).alias("ts_ms")).orderBy(F.desc("ts_ms"), "trace_id").limit(left)

    return _probe(f.range, n, found_in, seen, steps, growth).orderBy(F.desc("ts_ms"), "trace_id")
