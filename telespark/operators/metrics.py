"""Metric catalogue, series, histograms, events and exemplars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telespark.functions import histogram as H
from telespark.functions.attrs import AttrFilter, attr, attr_names
from telespark.functions.limits import at_most
from telespark.functions.ordered import previous
from telespark.functions.timeaxis import HOUR, MINUTE, Bucket, TimeRange, dense, millis

# Fixed values of the metric model.
METRIC_TYPES = ("Gauge", "Sum", "Histogram", "ExponentialHistogram", "Summary")
GROUP_COLUMNS = ("service_name", "scope_name", "scope_version", "temporality", "metric_unit")
FIELDS = ("value", "count", "sum", "min", "max")
POINT_AGGS = ("avg", "sum", "min", "max", "last", "count")
SERIES_AGGS = ("rate", "increase", "mean")
POD = "k8s.pod.name"
CATALOG_MS = 6 * HOUR
MAX_QUANTILES = 5
START_MARGIN_MS = 2 * MINUTE
FOLD_SERIES = 8


@dataclass(frozen=True)
class MetricFilter:
    range: TimeRange
    metric: str
    services: tuple[str, ...] = ()
    attrs: tuple[AttrFilter, ...] = ()
    resource_attrs: tuple[AttrFilter, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        if not 0 < len(self.metric.strip()) <= 256:
            raise ValueError("name one metric")
        conds = [self.range.holds(), F.col("metric_name") == self.metric.strip()]
        if self.services:
            conds.append(F.col("service_name").isin(list(self.services)))
        conds += [a.holds(df, "attributes") for a in self.attrs]
        conds += [a.holds(df, "resource_attributes") for a in self.resource_attrs]
        for c in conds:
            df = df.where(c)
        return df


def group_key(df: DataFrame, raw: str) -> tuple[str, Column]:
    """(label, text value) of a grouping dimension: a column, ``res:<key>`` for a
    resource attribute, ``attr:<key>`` or any other name for a point attribute."""
    raw = raw.strip()
    if raw.startswith("res:"):
        return raw, attr(df, "resource_attributes", raw[4:])
    if raw in GROUP_COLUMNS:
        return raw, F.col(raw).cast("string")
    name = raw.removeprefix("attr:")
    return name, attr(df, "attributes", name)


def metric_field(name: str) -> Column:
    if name not in FIELDS:
        raise ValueError(f"field must be one of {FIELDS}, not {name!r}")
    return F.col(name).cast("double")


def series_id(df: DataFrame) -> Column:
    """128-bit identity of one time series: service, scope and all attributes."""
    def entries(c):
        if isinstance(df.schema[c].dataType, T.MapType):
            return F.array_sort(F.map_entries(F.col(c)))
        return F.to_json(F.col(c))

    parts = ["service_name", "scope_name", entries("resource_attributes"), entries("attributes")]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))


# --- catalogue -----------------------------------------------------------------------

def metric_catalog(df: DataFrame, rng: TimeRange, services=None, contains: str = "", limit: int | None = None,
                   per_metric: int | None = None) -> DataFrame:
    """Metrics seen in the last six hours of the range, with the services that report
    them (the first ``per_metric`` by name)."""
    recent = TimeRange(max(rng.from_ms, rng.to_ms - CATALOG_MS), rng.to_ms)
    rows = df.where(recent.holds())
    if services:
        rows = rows.where(F.col("service_name").isin(list(services)))
    if contains:
        rows = rows.where(F.contains(F.lower("metric_name"), F.lit(contains.lower())))
    keys = ["metric_name", "metric_type", "metric_unit"]
    per_service = rows.groupBy(*keys, "service_name").agg(
        F.min("metric_description").alias("d"), F.min("temporality").alias("t"), F.max("is_monotonic").alias("m"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("service_name")) if per_metric is not None else F.lit(0)
    listed = F.col("service_name") if per_metric is None else F.when(F.col("rk") <= per_metric, F.col("service_name"))
    return at_most(per_service.withColumn("rk", rank).groupBy(*keys).agg(
        F.min("d").alias("description"), F.min("t").alias("temporality"),
        F.array_sort(F.collect_list(listed)).alias("services"),
        F.max("m").alias("is_monotonic"), F.sum("n").alias("points"))
        .orderBy(*keys), limit)


@dataclass(frozen=True)
class MetricKind:
    metric_type: str
    is_monotonic: bool
    has_bounds: bool

    @property
    def bucketed(self) -> bool:
        return self.metric_type.endswith("Histogram") or self.metric_type == "Summary"

    def default_agg(self) -> str:
        if self.bucketed:
            return "quantile" if self.metric_type == "Histogram" and self.has_bounds else "mean"
        if self.metric_type == "Sum":
            return "rate" if self.is_monotonic else "last"
        return "avg"

    def default_field(self, agg: str) -> str:
        if not self.bucketed:
            return "value"
        return {"rate": "count", "increase": "count", "count": "count", "min": "min", "max": "max"}.get(agg, "sum")

    def check(self, agg: str, field: str) -> None:
        """Reject combinations that would silently read an unused column."""
        if self.bucketed:
            if field == "value" and agg != "quantile":
                raise ValueError(f"{self.metric_type} has no value column; use count or sum")
            if agg == "quantile" and not self.has_bounds:
                raise ValueError(f"{self.metric_type} has no explicit bounds to interpolate in")
        elif agg == "quantile":
            raise ValueError(f"{self.metric_type} is not a histogram")
        elif field != "value":
            raise ValueError(f"{self.metric_type} only has the value column, not {field}")


def metric_kind(df: DataFrame, f: MetricFilter) -> MetricKind | None:
    """What kind of metric this is; one row decides, None when there is no point."""
    row = f.apply(df).select("metric_type", "is_monotonic", (F.size("explicit_bounds") > 0).alias("b")).head()
    return None if row is None else MetricKind(row[0], bool(row[1]), bool(row[2]))


def _name_counts(df: DataFrame, name: Column, limit: int | None) -> DataFrame:
    return at_most(df.groupBy(name.alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name"), limit)


def label_keys(df: DataFrame, f: MetricFilter, column: str = "attributes", limit: int | None = None) -> DataFrame:
    rows = f.apply(df).select(F.explode(attr_names(df, column)).alias("k"))
    return _name_counts(rows, F.col("k"), limit)


def label_values(df: DataFrame, f: MetricFilter, key: str, column: str = "attributes", limit: int | None = None) -> DataFrame:
    rows = f.apply(df).select(attr(df, column, key).alias("v")).where("v <> ''")
    return _name_counts(rows, F.col("v"), limit)


# --- series --------------------------------------------------------------------------------

def _keys(df: DataFrame, by) -> Column:
    return F.array(*[group_key(df, k)[1] for k in by]).cast("array<string>").alias("keys")


def _growth(cur: str, prev: str, dsum: str) -> Column:
    """Growth of a counter over one step: NULL at its first point, the whole value after
    a reset, the plain sum for deltas."""
    c, p = F.col(cur), F.col(prev)
    grown = F.when(F.col("prev_t").isNotNull(), F.when(c >= p, c - p).otherwise(c))
    return F.when(F.col("temp") == "Cumulative", grown).otherwise(F.col(dsum))


def series(df: DataFrame, f: MetricFilter, agg: str, field: str = "value", by=(), bucket: Bucket | None = None) -> DataFrame:
    """``bucket, keys, v`` for every point of every key set.

    Counters are first reduced to one row per (series, bucket); only then does the
    ``lag`` run, so its partitions hold at most as many rows as the chart has points."""
    bucket = bucket or Bucket.choose(f.range, "UTC", 60)
    v = metric_field(field)
    rows = f.apply(df)
    base = rows.withColumns({"bucket": bucket.index(), "keys": _keys(df, by), "x": v})
    if agg in POINT_AGGS:
        expr = {"avg": F.avg("x"), "sum": F.sum("x"), "min": F.min("x"), "max": F.max("x"),
                "last": F.max_by("x", F.unix_micros("timestamp")), "count": F.count("*").cast("double")}[agg]
        return base.groupBy("bucket", "keys").agg(expr.alias("v"))
    if agg not in SERIES_AGGS:
        raise ValueError(f"agg must be one of {POINT_AGGS + SERIES_AGGS}, not {agg!r}")
    us = F.unix_micros("timestamp")
    extra = [F.max_by(F.col("count").cast("double"), us).alias("cur_n"), F.sum(F.col("count").cast("double")).alias("dsum_n")]
    per = base.withColumn("series", series_id(df)).groupBy("bucket", "keys", "series").agg(
        F.max_by("x", us).alias("cur"), F.sum("x").alias("dsum"), F.max(millis()).alias("t"), F.min("temporality").alias("temp"),
        *(extra if agg == "mean" else []))
    w = Window.partitionBy("series", "keys").orderBy("bucket")
    lagged = per.withColumns({"prev": F.lag("cur").over(w), "prev_t": F.lag("t").over(w),
                              **({"prev_n": F.lag("cur_n").over(w)} if agg == "mean" else {})})
    inc = _growth("cur", "prev", "dsum")
    if agg == "increase":
        out = F.sum(inc)
    elif agg == "mean":
        out = F.sum(inc) / F.nullif(F.sum(_growth("cur_n", "prev_n", "dsum_n")), F.lit(0.0))
    else:
        gap = F.col("t") - F.col("prev_t")
        per_second = F.when(gap > 0, inc * 1000 / gap)       # over the real gap, not the bucket width
        out = F.sum(F.when(F.col("temp") == "Cumulative", per_second).otherwise(F.col("dsum") / (bucket.width_ms / 1000)))
    return lagged.groupBy("bucket", "keys").agg(out.alias("v"))


def histogram_increase(df: DataFrame, f: MetricFilter, by=(), bucket: Bucket | None = None) -> DataFrame:
    """``bucket, keys, bounds, counts``: per-bucket growth summed over series.  Layouts
    with other bounds stay apart."""
    bucket = bucket or Bucket.choose(f.range, "UTC", 60)
    rows = f.apply(df).where(F.size("bucket_counts") > 0).select(
        bucket.index().alias("bucket"), _keys(df, by), series_id(df).alias("series"), F.col("explicit_bounds").alias("bounds"),
        "bucket_counts", "temporality", F.unix_micros("timestamp").alias("us"))
    group = ["bucket", "keys", "bounds"]
    last = rows.where("temporality = 'Cumulative'").groupBy(*group, "series").agg(F.max_by("bucket_counts", "us").alias("cur"))
    w = Window.partitionBy("series", "keys", "bounds").orderBy("bucket")
    grown = last.select(*group, H.diff_counts(F.col("cur"), F.lag("cur").over(w)).alias("inc"))
    delta = rows.where("temporality <> 'Cumulative'").select(*group, F.col("bucket_counts").alias("inc"))
    cells = grown.unionByName(delta).select(*group, F.posexplode("inc").alias("pos", "n"))
    sums = cells.groupBy(*group, "pos").agg(F.sum("n").alias("n"))
    return sums.groupBy(*group).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda e: e["n"]).alias("counts"))


def histogram_quantile(hist: DataFrame, qs=(0.95,)) -> DataFrame:
    """One series per key set and quantile: ``bucket, keys (+ quantile label), v``."""
    if len(qs) > MAX_QUANTILES:
        raise ValueError(f"at most {MAX_QUANTILES} quantiles")
    each = F.array(*[F.struct(F.lit(H.quantile_label(q)).alias("label"),
                              H.quantile(F.col("counts"), F.col("bounds"), q).alias("v")) for q in qs])
    return (hist.select("bucket", "keys", F.inline(each))
                .select("bucket", F.concat("keys", F.array("label")).alias("keys"), "v"))


def series_lines(points: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per key set: ``keys, weight, line, rank, truncated`` with ``line`` an array
    of (bucket, v).  With a ``limit`` only the largest Σ|v|, ranked; without one all, unranked.

    Points of one key set are as many as the chart has buckets, so each line is a
    small array and the ranking is a plain top-n, without a window over everything."""
    lines = points.groupBy("keys").agg(
        F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("weight"),
        F.array_sort(F.collect_list(F.struct("bucket", "v"))).alias("line"))
    if limit is None:
        return lines.withColumns({"rank": F.lit(None).cast("int"), "truncated": F.lit(False)})
    top = lines.orderBy(F.desc("weight"), "keys").limit(limit + 1)      # one more tells whether any was cut
    place = Window.orderBy(F.desc("weight"), "keys")                    # over at most limit + 1 rows
    ranked = top.withColumns({"rank": F.row_number().over(place), "truncated": F.count("*").over(Window.partitionBy()) > limit})
    return ranked.where(F.col("rank") <= limit)


def top_series(points: DataFrame, limit: int | None = None) -> DataFrame:
    """Points of the ``limit`` largest key sets."""
    return (series_lines(points, limit).select("keys", "rank", "truncated", F.inline("line"))
            .select("bucket", "keys", "v", "rank", "truncated"))


def align_series(points: DataFrame, rng: TimeRange, bucket: Bucket, by=(), metric: str = "", limit: int | None = None) -> DataFrame:
    """Chart rows: one per series, ``values`` on the shared axis with NULL gaps, and
    min, max, avg, last of what is there."""
    first, n = bucket.first(rng), bucket.count(rng)
    lines = series_lines(points.where(F.col("bucket").between(first, bucket.last(rng))), limit)
    labels = list(by)
    if labels:
        name = F.concat_ws(", ", *[F.concat(F.lit(k + "="), F.when(F.coalesce(F.get("keys", F.lit(i)), F.lit("")) == "", "-")
                                            .otherwise(F.get("keys", F.lit(i)))) for i, k in enumerate(labels)])
    else:
        name = F.lit(metric)
    at = F.map_from_entries(F.filter("line", lambda e: e["bucket"].isNotNull()))
    values = F.transform(F.sequence(F.lit(first).cast("bigint"), F.lit(first + n - 1).cast("bigint")), lambda b: at[b])
    present = F.filter("values", lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, v: a + v)
    return lines.withColumn("values", values).select(
        "rank", name.alias("name"), "keys", "values", F.array_min(present).alias("min"), F.array_max(present).alias("max"),
        F.when(F.size(present) > 0, total / F.size(present)).alias("avg"), F.element_at(F.when(F.size(present) > 0, present), -1).alias("last"),
        "weight", "truncated")


def fold_other(points: DataFrame, rng: TimeRange, bucket: Bucket, keep: int = FOLD_SERIES) -> DataFrame:
    """Stacked-chart points: the ``keep`` largest series, the rest summed per bucket as
    ``other`` (NULL where all are), without a half-finished last bucket."""
    whole = points.where(F.col("bucket") < bucket.first(rng) + bucket.complete(rng))
    top = series_lines(points, keep).select("keys", "rank")
    ranked = whole.join(top, "keys", "left")
    key = F.when(F.col("rank").isNotNull(), F.col("keys"))
    return (ranked.groupBy("bucket", key.alias("keys")).agg(F.sum("v").alias("v"))
            .select(bucket.start(F.col("bucket")).alias("t_ms"), F.col("keys").isNull().alias("other"), "keys", "v"))


def is_error_label(value: Column) -> Column:
    """HTTP 5xx or an ERROR status."""
    return F.trim(value).rlike(r"^5\d\d$") | F.contains(F.upper(value), F.lit("ERROR"))


def metric_headline(rate_lines: DataFrame, latency_lines: DataFrame) -> DataFrame:
    """Request rate, error share, P95 and P99 from aligned rate and quantile series."""
    erring = F.exists("keys", is_error_label)
    rates = rate_lines.agg(F.sum("avg").alias("rate"), F.sum(F.when(erring, F.col("avg"))).alias("errors"))
    quantile = lambda p: F.max(F.when(F.array_contains("keys", p), F.col("avg")))
    tail = latency_lines.agg(F.struct(quantile("p95").alias("p95"), quantile("p99").alias("p99")).alias("q")).scalar()
    return (rates.withColumn("q", tail).select(
        "rate", F.when(F.col("rate") > 0, F.coalesce("errors", F.lit(0.0)) / F.col("rate")).alias("error_rate"), "q.p95", "q.p99"))


def top_table(lines: DataFrame) -> DataFrame:
    """Series by average, largest first, with their share of the total."""
    named = lines.where(F.size("keys") > 0).withColumn("value", F.coalesce("avg", F.lit(0.0)))
    total = named.agg(F.sum("value")).scalar()
    return (named.select("name", "keys", "value", F.when(total > 0, F.col("value") / total).otherwise(0.0).alias("share"))
                 .orderBy(F.desc("value"), "name"))


# --- events and exemplars -----------------------------------------------------------------------

def _pods(df: DataFrame, f: MetricFilter) -> DataFrame:
    return f.apply(df).withColumn("pod", attr(df, "resource_attributes", POD))


def watched(df: DataFrame, f: MetricFilter, field: str | None = "value") -> DataFrame:
    """``service_name, pod, timestamp, v, watched``: the column whose falls are restarts. Without a ``field``, points of
    bucketed types are watched through their count and all others through their value, each by itself."""
    bucketed = F.coalesce(F.col("metric_type").endswith("Histogram") | (F.col("metric_type") == "Summary"), F.lit(False))
    v = F.when(bucketed, metric_field("count")).otherwise(metric_field("value")) if field is None else metric_field(field)
    return _pods(df, f).select("service_name", "pod", "timestamp", v.alias("v"), (bucketed if field is None else F.lit(False)).alias("watched"))


def counter_restarts(df: DataFrame, f: MetricFilter, field: str | None = "value", limit: int | None = None) -> DataFrame:
    """Moments where a counter of a (service, pod) fell: the process came back in place.  The previous sample is found across ranges of (pod, time), so a
    pod of any size is split."""
    hits = (previous(watched(df, f, field), ["service_name", "pod", "watched"], ["timestamp", "v"], ["v"])
            .where((F.col("prev_v") > 0) & (F.col("v") < F.col("prev_v")))
            .select(millis().alias("t_ms"), "pod", "service_name"))
    return hits if limit is None else hits.orderBy("t_ms", "service_name", "pod").limit(limit)


def pod_starts(df: DataFrame, f: MetricFilter, margin_ms: int = START_MARGIN_MS, limit: int | None = None) -> DataFrame:
    """Pods first seen clearly after the window began."""
    first = (_pods(df, f).where("pod <> ''").groupBy("service_name", "pod").agg(F.min(millis()).alias("t_ms"))
             .where(F.col("t_ms") > f.range.from_ms + margin_ms).select("t_ms", "pod", "service_name"))
    return first if limit is None else first.orderBy("t_ms", "service_name", "pod").limit(limit)


def metric_events(df: DataFrame, f: MetricFilter, field: str | None = None, limit: int | None = None) -> DataFrame:
    """Restarts and starts by time.  Histograms are watched through their count, point by point."""
    return (counter_restarts(df, f, field, limit).withColumn("kind", F.lit("restart"))
            .unionByName(pod_starts(df, f, limit=limit).withColumn("kind", F.lit("start")))
            .orderBy("t_ms", "kind", "service_name", "pod"))


def exemplars(df: DataFrame, f: MetricFilter, limit: int | None = None) -> DataFrame:
    """Traces attached to points, largest value first; all if ``limit`` is None."""
    rows = f.apply(df).where(F.size("exemplars") > 0).select("service_name", F.inline("exemplars"))
    return at_most(rows.where("trace_id <> ''")
                   .select(millis().alias("t_ms"), "value", "trace_id", "span_id", "service_name")
                   .orderBy(F.desc("value"), F.desc("t_ms"), "trace_id"), limit)


def chart_cells(points: DataFrame, rng: TimeRange, bucket: Bucket) -> DataFrame:
    """Long form of a chart: every (bucket, key set) cell, NULL where nothing was seen."""
    return dense(bucket, rng, points, points.select("keys").distinct())
