"""Span figures as mergeable states, so that time ranges are put together from stored slices.

A state row holds counts, sums and a KLL sketch of the durations for one group and time bucket. States of several
buckets, services or days merge into the state of all their spans; no span is read again. A sketch of at most ``k``
durations is exact, a larger one is off by a rank error that shrinks with ``k`` (about 1.7 / k), however often it was merged.

``span_rollup`` makes the states in one scan. ``stats``, ``operations``, ``overview`` and ``compare`` answer from the
states alone: a range and its comparison window must therefore start and end on bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.functions.maths import ms, share
from telespark.functions.timeaxis import Bucket, TimeRange, compare_shift
from telespark.operators.traces import ENTRY_KINDS, is_error

ACCURACY = 1600
QUANTILES = (0.5, 0.95, 0.99)
OPERATION = ("service_name", "span_name", "span_kind")


def states(k: int = ACCURACY) -> list[Column]:
    """State of a group of spans."""
    return [F.count("*").alias("requests"), F.count_if(is_error()).alias("errors"), F.sum("duration_ns").alias("total_ns"),
            F.max("duration_ns").alias("max_ns"), F.kll_sketch_agg_bigint("duration_ns", k).alias("sketch")]


def merged() -> list[Column]:
    """State of a group of states."""
    return [*[F.sum(c).alias(c) for c in ("requests", "errors", "total_ns")], F.max("max_ns").alias("max_ns"), F.kll_merge_agg_bigint("sketch").alias("sketch")]


def figures(prefix: str = "", sketch: str = "sketch") -> list[Column]:
    """Milliseconds at 50, 95 and 99 %."""
    of = F.kll_sketch_get_quantile_bigint(sketch, F.array(*map(F.lit, QUANTILES)))
    return [ms(F.get(of, F.lit(i))).alias(f"{prefix}p{round(100 * q)}_ms") for i, q in enumerate(QUANTILES)]


def span_rollup(spans: DataFrame, bucket: Bucket, rng: TimeRange | None = None, by=OPERATION, kinds=None, k: int = ACCURACY) -> DataFrame:
    """One state for each group and bucket; spans of all kinds unless ``kinds`` names some."""
    rows = spans if rng is None else spans.where(rng.holds())
    if kinds:
        rows = rows.where(F.col("span_kind").isin(list(kinds)))
    return rows.groupBy(*by, bucket.index().alias("bucket")).agg(*states(k))


def _inside(rollup: DataFrame, rng: TimeRange, bucket: Bucket) -> DataFrame:
    for at in (rng.from_ms, rng.to_ms):
        if (at - bucket.origin_ms) % bucket.width_ms:
            raise ValueError(f"{at} is not on a border of the buckets of {bucket.width_ms} ms that the states are kept in")
    return rollup.where(F.col("bucket").between(bucket.first(rng), bucket.last(rng)))


def _entry(rollup: DataFrame) -> DataFrame:
    return rollup.where(F.col("span_kind").isin(list(ENTRY_KINDS))) if "span_kind" in rollup.columns else rollup


def stats(rollup: DataFrame, rng: TimeRange, bucket: Bucket) -> DataFrame:
    """Per service, whole range (``is_total`` 1, ``bucket`` NULL) and per bucket: as ``services.service_stats``."""
    service, b = F.col("service_name"), F.col("bucket")
    out = _entry(_inside(rollup, rng, bucket)).groupingSets([[service], [service, b]], service, b).agg(F.grouping("bucket").alias("is_total"), *merged())
    return out.select("service_name", "is_total", "bucket", "requests", "errors", *figures(), ms(F.col("max_ns")).alias("max_ms"))


def operations(rollup: DataFrame, rng: TimeRange, bucket: Bucket, by=OPERATION) -> DataFrame:
    """Figures of each operation over the range."""
    out = _inside(rollup, rng, bucket).groupBy(*by).agg(*merged())
    return out.select(*by, "requests", "errors", share(F.col("errors"), F.col("requests")).alias("error_rate"), *figures(),
                      ms(F.col("max_ns")).alias("max_ms"), ms(F.col("total_ns")).alias("total_ms"))


def compare(rollup: DataFrame, rng: TimeRange, bucket: Bucket, kind: str = "prev", by=OPERATION) -> DataFrame:
    """Each operation next to the earlier window, from one pass over the states: ``state`` is new, gone or both.

    Windows may overlap: a state then counts for both.
    """
    shift = compare_shift(kind, rng)
    if shift is None:
        raise ValueError("a comparison needs an earlier window")
    before = rng.shift(-shift)
    now_in, then_in = (F.col("bucket").between(bucket.first(r), bucket.last(r)) for r in (rng, before))
    _inside(rollup, rng, bucket), _inside(rollup, before, bucket)
    wins = F.filter(F.array(F.when(now_in, F.lit(0)), F.when(then_in, F.lit(1))), lambda w: w.isNotNull())
    each = rollup.where(now_in | then_in).withColumn("win", F.explode(wins)).groupBy(*by, "win").agg(*merged())
    side = lambda w, c: F.max(F.when(F.col("win") == w, F.col(c)))
    out = each.groupBy(*by).agg(*[side(w, c).alias(f"{p}{c}") for w, p in ((0, ""), (1, "prev_")) for c in ("requests", "errors", "max_ns", "sketch")])
    state = F.when(F.col("prev_requests").isNull(), "new").when(F.col("requests").isNull(), "gone").otherwise("both")
    return out.select(*by, state.alias("state"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "errors", "prev_requests", "prev_errors")],
                      *figures(), *figures("prev_", "prev_sketch"), ms(F.col("max_ns")).alias("max_ms"), ms(F.col("prev_max_ns")).alias("prev_max_ms"))
