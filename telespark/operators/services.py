"""Service and operation figures, compared with an earlier window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.maths import change, change_pct, ms, quantiles, ratio, share
from telespark.functions.limits import at_most_per
from telespark.functions.timeaxis import SPAN_BUCKETS, SPARK_BUCKETS, Bucket, TimeRange, compare_shift, dense
from telespark.operators.traces import ENTRY_KINDS, KIND_GROUPS, is_error
from telespark.sources.schema import SPAN_COLUMNS, check_dimension

# Health thresholds.
ERROR_RATE_BAD, ERROR_RATE_WARN = 0.05, 0.01
P95_BAD, P95_WARN, P95_FLOOR_MS = 3.0, 1.5, 200.0
HEALTH_SAMPLES = 300
STARTED_ERRORING_RATE = 0.002
# When an operation counts as changed.
MOVER_SAMPLES = 100
MOVER_P95_RATIO, MOVER_P95_MS = 1.3, 20.0
MOVER_ERRORS, MOVER_ERROR_RATE = 5, 0.005
MOVER_TRAFFIC_RATIO, MOVER_TRAFFIC = 1.3, 100
MOVER_APPEAR = 100
HOTSPOT_SHARE, HOTSPOT_MS, HOTSPOT_RATIO = 0.02, 10_000.0, 2.0
CONTRIBUTOR_REQUESTS = 30


def _figures() -> list[Column]:
    return [F.count("*").alias("requests"), F.count_if(is_error()).alias("errors"),
            quantiles(F.col("duration_ns")).alias("q"), F.max("duration_ns").alias("max_ns")]


def _in_ms(prefix: str = "") -> list[Column]:
    return [*[ms(F.col("q")[i]).alias(f"{prefix}p{p}_ms") for i, p in enumerate((50, 95, 99))],
            ms(F.col("max_ns")).alias(f"{prefix}max_ms")]


def _entry(df: DataFrame, kinds=ENTRY_KINDS, dims: dict | None = None) -> DataFrame:
    df = df.where(F.col("span_kind").isin(list(kinds)))
    for name, values in (dims or {}).items():
        if values:
            df = df.where(F.col(check_dimension(df, SPAN_COLUMNS, name)).isin(list(values)))
    return df


def service_stats(df: DataFrame, rng: TimeRange, bucket: Bucket, dims: dict | None = None) -> DataFrame:
    """Per service, whole window (``is_total`` 1, ``bucket`` NULL) and per bucket, in one scan."""
    rows = _entry(df, dims=dims).where(rng.holds()).select(
        "service_name", bucket.index().alias("bucket"), "duration_ns", "status_code")
    service, b = F.col("service_name"), F.col("bucket")
    out = rows.groupingSets([[service], [service, b]], service, b).agg(F.grouping("bucket").alias("is_total"), *_figures())
    return out.select("service_name", "is_total", "bucket", "requests", "errors", *_in_ms())


def _two_windows(rows: DataFrame, rng: TimeRange, shift: int | None, bucket: Bucket | None = None) -> DataFrame:
    """Rows of the current (``win`` 0) and the earlier window (``win`` 1) with the bucket
    number relative to the window's first one.  One scan unless the windows overlap."""
    prev = rng.shift(-shift) if shift is not None else None
    first = bucket.first(rng) if bucket else 0

    def tagged(df, win, back):
        cols = [F.lit(win).alias("win")]
        if bucket:
            cols.append((bucket.shifted(-back).index() - first).alias("slot"))
        return df.select("*", *cols)

    cur_rows = rows.where(rng.holds())
    if prev is None:
        return tagged(cur_rows, 0, 0)
    back = rng.from_ms - prev.from_ms
    if back < rng.span_ms:
        return tagged(cur_rows, 0, 0).unionByName(tagged(rows.where(prev.holds()), 1, back))
    both = rows.where(rng.holds() | prev.holds()).withColumn("win", F.when(rng.holds(), 0).otherwise(1))
    if not bucket:
        return both
    here, there = bucket.index() - first, bucket.shifted(-back).index() - first
    return both.withColumn("slot", F.when(F.col("win") == 0, here).otherwise(there))


def _side(win: int, value) -> Column:
    return F.max(F.when(F.col("win") == win, value))


def _secs(rng: TimeRange) -> float:
    return max(1.0, rng.span_ms / 1000)


def service_overview(df: DataFrame, rng: TimeRange, compare: str = "day", tz: str = "UTC", dims: dict | None = None) -> DataFrame:
    """One row per service seen now: figures, the earlier window's, and three sparklines
    (requests, errors, earlier requests) without a half-finished last slot."""
    bucket = Bucket.choose(rng, tz, SPARK_BUCKETS)
    shift = compare_shift(compare, rng)
    prev_rng = rng.shift(-shift) if shift is not None else rng
    slots = bucket.complete(rng)
    rows = _two_windows(_entry(df, dims=dims), rng, shift, bucket).select(
        "service_name", "win", "slot", "duration_ns", "status_code")
    service, win, slot = F.col("service_name"), F.col("win"), F.col("slot")
    g = rows.groupingSets([[service, win], [service, win, slot]], service, win, slot).agg(
        F.grouping("slot").alias("is_total"), *_figures()).withColumnsRenamed({"requests": "n", "errors": "e", "max_ns": "top"})
    total = F.col("is_total") == 1

    def one(w, value):
        return F.max(F.when(total & (win == w), value))

    def line(w, value):
        # at most one value per slot, so the list is as short as the axis
        seen = F.map_from_entries(F.collect_list(F.when(
            ~total & (win == w) & (slot >= 0) & (slot < slots), F.struct(slot, F.col(value)))))
        return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint")),
                           lambda i: F.coalesce(seen[i], F.lit(0)))

    out = g.groupBy("service_name").agg(
        one(0, F.col("n")).alias("requests"), one(0, F.col("e")).alias("errors"), one(0, F.col("top")).alias("max_ns"),
        *[one(0, F.col("q")[i]).alias(f"q{i}") for i in range(3)],
        one(1, F.col("n")).alias("prev_requests"), one(1, F.col("e")).alias("prev_errors"),
        one(1, F.col("q")[1]).alias("prev_q1"),
        line(0, "n").alias("spark_requests"), line(0, "e").alias("spark_errors"),
        line(1, "n").alias("spark_prev_requests")).where("requests is not null")
    return out.select(
        "service_name", "requests", "errors", share(F.col("errors"), F.col("requests")).alias("error_rate"),
        (F.col("requests") / _secs(rng)).alias("rps"), ms(F.col("q0")).alias("p50_ms"), ms(F.col("q1")).alias("p95_ms"),
        ms(F.col("q2")).alias("p99_ms"), ms(F.col("max_ns")).alias("max_ms"), "prev_requests", "prev_errors",
        F.when(F.col("prev_requests").isNotNull(), share(F.col("prev_errors"), F.col("prev_requests"))).alias("prev_error_rate"),
        (F.col("prev_requests") / _secs(prev_rng)).alias("prev_rps"), ms(F.col("prev_q1")).alias("prev_p95_ms"),
        "spark_requests", "spark_errors", "spark_prev_requests")


def _operation_rows(rows: DataFrame, extra: list[str], per_service: int) -> DataFrame:
    g = rows.groupBy(*extra, "service_name", "span_name", "span_kind").agg(*_figures())
    return at_most_per(g, [*extra, "service_name"], [F.desc("requests"), "span_name", "span_kind"], per_service)


def service_operations(df: DataFrame, rng: TimeRange, kind: str = "entry", services=None,
                       per_service: int | None = None) -> DataFrame:
    """Figures per (service, span name, kind): the busiest ones of each service."""
    rows = _entry(df, KIND_GROUPS[kind]).where(rng.holds())
    if services:
        rows = rows.where(F.col("service_name").isin(list(services)))
    out = _operation_rows(rows, [], per_service)
    return out.select("service_name", "span_name", "span_kind", "requests", "errors",
                      share(F.col("errors"), F.col("requests")).alias("error_rate"),
                      (F.col("requests") / _secs(rng)).alias("rps"), *_in_ms())


def compare_operations(df: DataFrame, rng: TimeRange, compare: str = "day", kind: str = "entry", services=None,
                       per_service: int | None = None) -> DataFrame:
    """Operations of now next to those of the earlier window.

    ``status`` is ``new`` without an earlier side, ``gone`` (zero figures) when only the
    earlier side exists.  A service that hit the cap reports nothing as gone;
    ``truncated`` marks it.  Both sides come from one aggregation, so no join."""
    shift = compare_shift(compare, rng)
    rows = _entry(df, KIND_GROUPS[kind])
    if services:
        rows = rows.where(F.col("service_name").isin(list(services)))
    g = _operation_rows(_two_windows(rows, rng, shift), ["win"], per_service)
    keys = ["service_name", "span_name", "span_kind"]
    sides = g.groupBy(*keys).agg(
        *[_side(0, F.col(c)).alias(c) for c in ("requests", "errors", "max_ns", "q")],
        *[_side(1, F.col(c)).alias(f"prev_{c}") for c in ("requests", "errors", "q")])
    size = F.count("requests").over(Window.partitionBy("service_name"))
    sides = sides.withColumn("truncated", F.lit(False) if per_service is None else size >= per_service)
    sides = sides.where(F.col("requests").isNotNull() | ~F.col("truncated"))
    prev_secs = _secs(rng.shift(-shift)) if shift is not None else 1.0
    zero = lambda c: F.coalesce(c, F.lit(0))
    has_prev = F.col("prev_requests").isNotNull()
    status = (F.when(F.col("requests").isNull(), "gone").when(~has_prev, "new") if shift is not None
              else F.lit(None).cast("string"))
    return sides.select(
        *keys, zero(F.col("requests")).alias("requests"), zero(F.col("errors")).alias("errors"),
        share(zero(F.col("errors")), zero(F.col("requests"))).alias("error_rate"),
        (zero(F.col("requests")) / _secs(rng)).alias("rps"),
        *[F.coalesce(ms(F.col("q")[i]), F.lit(0.0)).alias(f"p{p}_ms") for i, p in enumerate((50, 95, 99))],
        F.coalesce(ms(F.col("max_ns")), F.lit(0.0)).alias("max_ms"),
        "prev_requests", "prev_errors",
        F.when(has_prev, share(F.col("prev_errors"), F.col("prev_requests"))).alias("prev_error_rate"),
        (F.col("prev_requests") / prev_secs).alias("prev_rps"),
        *[ms(F.col("prev_q")[i]).alias(f"prev_p{p}_ms") for i, p in enumerate((50, 95, 99))],
        status.alias("status"), "truncated")


def shape_operations(ops: DataFrame, sort: str = "requests", limit: int | None = None) -> DataFrame:
    """Add the changes worth sorting by and order the table."""
    prev_rate = F.col("prev_requests")
    slower = F.when((F.col("requests") >= MOVER_SAMPLES) & (prev_rate >= MOVER_SAMPLES),
                    F.greatest(F.col("p95_ms") - F.col("prev_p95_ms"), F.lit(0.0)) * F.col("requests")).otherwise(F.lit(0.0))
    more = F.coalesce(F.col("errors") - F.col("prev_errors"), F.lit(0))
    out = ops.withColumns({
        "p95_change": slower, "errors_change": more,
        "requests_change_pct": change_pct(F.col("requests"), F.col("prev_requests")),
        "p95_ratio": ratio(F.col("p95_ms"), F.col("prev_p95_ms"))})
    by = {"requests": "requests", "errors": "errors", "p95": "p95_ms", "p95_change": "p95_change", "errors_change": "errors_change"}
    if sort not in by:
        raise ValueError(f"sort must be one of {sorted(by)}, not {sort!r}")
    out = out.orderBy(F.desc(by[sort]), "service_name", "span_name", "span_kind")
    return out.limit(limit) if limit else out


def service_timeseries(df: DataFrame, rng: TimeRange, service: str, span_name: str | None = None, compare: str = "day",
                       tz: str = "UTC", max_buckets: int = SPAN_BUCKETS) -> DataFrame:
    """Every bucket of the range: 0 where nothing happened now, NULL where nothing
    happened at the same relative place of the earlier window."""
    bucket = Bucket.choose(rng, tz, max_buckets)
    rows = _entry(df).where(F.col("service_name") == service)
    if span_name is not None:
        rows = rows.where(F.col("span_name") == span_name)
    g = _two_windows(rows, rng, compare_shift(compare, rng), bucket).groupBy("slot", "win").agg(*_figures())
    first = bucket.first(rng)
    points = g.groupBy((F.col("slot") + first).alias("bucket")).agg(
        *[_side(0, F.col(c)).alias(c) for c in ("requests", "errors", "q")],
        *[_side(1, F.col(c)).alias(f"prev_{c}") for c in ("requests", "errors", "q")])
    grid = dense(bucket, rng, points, zero=["requests", "errors"])
    return grid.select(
        bucket.start(F.col("bucket")).alias("t_ms"), "requests", "errors",
        *[F.coalesce(ms(F.col("q")[i]), F.lit(0.0)).alias(f"p{p}_ms") for i, p in enumerate((50, 95, 99))],
        "prev_requests", "prev_errors", ms(F.col("prev_q")[1]).alias("prev_p95_ms"))


# --- judgement -------------------------------------------------------------------------

def service_health(overview: DataFrame, started_erroring_rate: float = STARTED_ERRORING_RATE) -> DataFrame:
    """Add ``health`` (bad, warn, ok), ``reasons`` and ``health_rank``; worst first, then
    by volume.  ``started_erroring_rate=0`` gives the stricter variant of that rule."""
    rate, p95, prev_p95 = F.col("error_rate"), F.col("p95_ms"), F.col("prev_p95_ms")
    enough = (F.col("requests") >= HEALTH_SAMPLES) & (F.coalesce("prev_requests", F.lit(0)) >= HEALTH_SAMPLES)
    r = F.when(enough & (prev_p95 > 0) & (p95 >= P95_FLOOR_MS), p95 / prev_p95)
    slow_bad, slow_warn = F.coalesce(r >= P95_BAD, F.lit(False)), F.coalesce(r >= P95_WARN, F.lit(False))
    started = F.coalesce((F.col("prev_errors") == 0) & (F.col("errors") > 0) & (rate >= started_erroring_rate), F.lit(False))
    level = (F.when((rate >= ERROR_RATE_BAD) | slow_bad, "bad")
              .when((rate >= ERROR_RATE_WARN) | slow_warn | started, "warn").otherwise("ok"))
    reasons = F.array_compact(F.array(F.when(rate >= ERROR_RATE_WARN, "error_rate"), F.when(slow_warn, "p95_ratio"),
                                      F.when(started, "started_erroring")))
    out = overview.withColumns({"health": level, "reasons": reasons, "p95_ratio": F.round(r, 2)})
    return (out.withColumn("health_rank", F.when(F.col("health") == "bad", 0).when(F.col("health") == "warn", 1).otherwise(2))
               .orderBy("health_rank", F.desc("requests"), "service_name"))


def with_warning(health: DataFrame, hot: DataFrame) -> DataFrame:
    """Raise services that have a latency hotspot to at least ``warn``."""
    out = health.join(hot.select("service_name", F.lit(True).alias("__hot")), "service_name", "left")
    hit = F.coalesce("__hot", F.lit(False))
    return out.withColumns({
        "reasons": F.when(hit, F.concat("reasons", F.array(F.lit("latency_hotspot")))).otherwise(F.col("reasons")),
        "health_rank": F.when(hit, F.least("health_rank", F.lit(1))).otherwise(F.col("health_rank")),
        "health": F.when(hit & (F.col("health") == "ok"), "warn").otherwise(F.col("health"))}).drop("__hot")


def _classify(ops: DataFrame) -> DataFrame:
    """Label every operation (``mover`` NULL where nothing is worth saying)."""
    n, p = F.col("requests"), F.col("prev_requests")
    d_err = F.col("errors") - F.col("prev_errors")
    erring = (F.abs(d_err) >= MOVER_ERRORS) & ((F.col("error_rate") >= MOVER_ERROR_RATE) | (F.col("prev_error_rate") >= MOVER_ERROR_RATE))
    p95, q95 = F.col("p95_ms"), F.col("prev_p95_ms")
    r = F.when(q95 > 0, p95 / q95)
    slower = ((n >= MOVER_SAMPLES) & (p >= MOVER_SAMPLES) & (F.abs(p95 - q95) >= MOVER_P95_MS)
              & ((r >= MOVER_P95_RATIO) | (r <= 1 / MOVER_P95_RATIO)))
    flow = F.when(p > 0, n / p).otherwise(F.lit(float("inf")))
    busier = (F.abs(n - p) >= MOVER_TRAFFIC) & ((flow >= MOVER_TRAFFIC_RATIO) | (flow <= 1 / MOVER_TRAFFIC_RATIO))
    kind = (F.when(p.isNull(), F.when(n >= MOVER_APPEAR, "new"))
             .when(n == 0, F.when(p >= MOVER_APPEAR, "gone"))
             .when(erring, "errors").when(slower, "latency").when(busier, "traffic"))
    mover = F.col("mover")
    better = F.when(mover == "errors", d_err < 0).when(mover == "latency", r < 1).otherwise(False)
    score = (F.when(mover == "new", n).when(mover == "gone", p).when(mover == "errors", F.abs(d_err))
              .when(mover == "latency", F.abs((p95 - q95) * n)).otherwise(F.abs(n - p))).cast("double")
    tone = (F.when(mover == "gone", "warn")
             .when(mover == "errors", F.when(F.col("better"), "ok").otherwise("danger"))
             .when(mover == "latency", F.when(F.col("better"), "ok").when(r >= HOTSPOT_RATIO, "danger").otherwise("warn"))
             .otherwise("muted"))
    place = F.array_position(F.array(*map(F.lit, ("gone", "errors", "latency", "new", "traffic"))), mover) - 1
    return (ops.withColumn("mover", kind).withColumns({"better": better, "score": score})
               .withColumns({"tone": tone, "mover_rank": place + F.when(F.col("better"), 10).otherwise(0)}))


NAME_ORDER = ("span_name", "span_kind")


def operation_movers(ops: DataFrame, top: int | None = None) -> DataFrame:
    """Operations worth mentioning, one label each, in the order gone, errors, latency,
    new, traffic; improvements after all bad news; ``top`` per service (all if None).

    ``score`` is the impact: requests, failed requests, or extra milliseconds."""
    w = Window.partitionBy("service_name").orderBy("mover_rank", F.desc("score"), *NAME_ORDER)
    out = _classify(ops).where("mover is not null").withColumn("place", F.row_number().over(w))
    return out.where(F.col("place") <= top) if top else out


def _is_hotspot(window_ms: int) -> Column:
    floor = max(HOTSPOT_MS, window_ms * HOTSPOT_SHARE)
    return F.coalesce((F.col("mover") == "latency") & (F.col("tone") == "danger") & (F.col("score") >= floor), F.lit(False))


def latency_hotspot(ops: DataFrame, window_ms: int) -> DataFrame:
    """Per service the operation that got at least twice as slow and cost the most extra
    time, if that is a noticeable part of the window."""
    w = Window.partitionBy("service_name").orderBy(F.desc("score"), *NAME_ORDER)
    hot = _classify(ops).where(_is_hotspot(window_ms))
    return hot.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def main_contributor(ops: DataFrame, window_ms: int) -> DataFrame:
    """Per service the operation to name on its card: the top mover; with a hotspot, the
    next bad mover of another name among the top four; without movers, the slowest
    operation with enough requests.  One pass over the (capped) operations of a service."""
    service = Window.partitionBy("service_name")
    ranked = _classify(ops).withColumn("hot", _is_hotspot(window_ms)).withColumns({
        "hot_name": F.max_by(F.when(F.col("hot"), F.col("span_name")), F.when(F.col("hot"), F.col("score"))).over(service),
        "place": F.row_number().over(service.orderBy(F.col("mover").isNull(), "mover_rank", F.desc("score"), *NAME_ORDER))})
    is_mover, cold = F.col("mover").isNotNull(), F.col("hot_name").isNull()
    next_bad = (F.col("place") <= 4) & (F.col("span_name") != F.col("hot_name")) & ~F.col("better") & (F.col("tone") != "muted")
    wanted = F.when(is_mover, F.when(cold, F.col("place") == 1).otherwise(next_bad)).otherwise(False)
    slow = cold & ~wanted & (F.col("requests") >= CONTRIBUTOR_REQUESTS)
    w = service.orderBy(F.when(wanted, F.col("place")).otherwise(1000), F.desc("p95_ms"), *NAME_ORDER)
    return (ranked.where(wanted | slow).withColumn("rk", F.row_number().over(w)).where("rk = 1")
            .select("service_name", *NAME_ORDER, "requests", F.when(wanted, F.col("mover")).otherwise("slowest").alias("mover")))


def site_overview(health: DataFrame, rng: TimeRange, compare: str = "day", restarts: DataFrame | None = None) -> DataFrame:
    """The whole site in one row: volume, error rate, change, services in trouble."""
    shift = compare_shift(compare, rng)
    secs, prev_secs = _secs(rng), _secs(rng.shift(-shift)) if shift is not None else 1.0
    n = F.sum("requests")
    p = F.sum("prev_requests")
    rate = share(F.sum("errors"), n)
    prev_rate = share(F.coalesce(F.sum("prev_errors"), F.lit(0)), F.coalesce(p, F.lit(0)))
    out = health.agg(
        n.alias("requests"), (n / secs).alias("rps"), rate.alias("error_rate"),
        F.when(p.isNotNull(), change(n / secs, p / prev_secs)).alias("rps_change"),
        F.when(p.isNotNull(), change(rate, prev_rate)).alias("error_rate_change"),
        F.count_if(F.col("health") != "ok").alias("unhealthy"), F.count("*").alias("services"))
    n_restarts = restarts.agg(F.count("*")).scalar() if restarts is not None else F.lit(0).cast("bigint")
    return out.withColumn("restarts", n_restarts)


def site_trend(overview: DataFrame) -> DataFrame:
    """Site-wide sparkline: ``slot, requests, errors, prev_requests``."""
    lines = F.arrays_zip("spark_requests", "spark_errors", "spark_prev_requests")
    slots = overview.select(F.posexplode(lines).alias("slot", "v"))
    return slots.groupBy("slot").agg(F.sum("v.spark_requests").alias("requests"), F.sum("v.spark_errors").alias("errors"),
                                     F.sum("v.spark_prev_requests").alias("prev_requests"))
