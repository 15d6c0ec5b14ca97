"""Trace search, summaries, details, heat map and error groups."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.attrs import AttrFilter, attr, attr_names, first_attr, flatten_attributes, value_in
from telespark.functions.keywords import contains_ci
from telespark.functions.ordered import row_position
from telespark.functions.limits import at_most
from telespark.functions.maths import head
from telespark.functions.timeaxis import DAY, HOUR, MINUTE, SPAN_BUCKETS, Bucket, TimeRange, millis
from telespark.sources.schema import SPAN_COLUMNS, check_dimension

# Fixed values of the span model.
SPAN_KINDS = ("Server", "Client", "Internal", "Producer", "Consumer", "Unspecified")
ENTRY_KINDS = ("Server", "Consumer")
CLIENT_KINDS = ("Client", "Producer")
KIND_GROUPS = {"entry": ENTRY_KINDS, "client": CLIENT_KINDS, "all": ()}
UNSCOPED_MS = 6 * HOUR
SUMMARY_PAD_MS = 10 * MINUTE
HEATMAP_BINS = 4
ERROR_MESSAGE_CHARS = 160
ERROR_GROUP_KEYS = ("service_name", "span_kind", "span_name", "exc_type", "exc_msg", "http_status", "peer")


# --- scalar helpers ---------------------------------------------------------

def normalize_trace_id(raw: Column) -> Column:
    """32 lower-case hex digits, shorter ids padded; NULL when it is not an id."""
    return _hex_id(raw, 32)


def normalize_span_id(raw: Column) -> Column:
    return _hex_id(raw, 16)


def _hex_id(raw: Column, width: int) -> Column:
    text = F.lower(F.trim(raw))
    return F.when(text.rlike(f"^[0-9a-f]{{1,{width}}}$"), F.lpad(text, width, "0"))


def normalize_kind(raw: Column) -> Column:
    """Canonical span kind, or NULL for an unknown one."""
    out = None
    for k in SPAN_KINDS:
        cond = F.lower(F.trim(raw)) == k.lower()
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return out


def span_subtitle(df: DataFrame, column: str = "span_attributes") -> Column:
    """One line that says what a span did, by attribute family."""
    def a(*keys):
        return first_attr(df, column, keys)

    def words(*parts):
        return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])

    method, status = a("http.request.method", "http.method"), a("http.response.status_code", "http.status_code")
    path = a("url.path", "http.target", "url.full", "http.url", "http.route")
    return (F.when(method != "", words(method, path, F.when(status != "", F.concat(F.lit("→ "), status)).otherwise("")))
             .when(a("db.system") != "", words(a("db.system"), a("db.statement", "db.operation")))
             .when(a("messaging.system") != "",
                   F.trim(F.concat_ws(" ", a("messaging.system"), a("messaging.destination.name"), a("messaging.operation"))))
             .when(a("rpc.system") != "", F.concat(a("rpc.system"), F.lit(" "), a("rpc.service"), F.lit("/"), a("rpc.method")))
             .when(a("code.namespace") != "", F.concat(a("code.namespace"), F.lit("."), a("code.function")))
             .otherwise(""))


def event_attr(df: DataFrame, key: str) -> Column:
    """First non-empty value of one attribute over a span's events."""
    dtype = df.schema["events"].dataType.elementType["attributes"].dataType
    values = F.transform("events", lambda e: value_in(e["attributes"], dtype, key))
    return F.coalesce(F.get(F.filter(values, lambda v: v != ""), 0), F.lit(""))


def zip_events(timestamps: Column, names: Column, attributes: Column) -> Column:
    """Parallel arrays as one array of structs; as long as ``timestamps``."""
    return F.transform(timestamps, lambda t, i: F.struct(
        t.alias("timestamp"), F.coalesce(F.get(names, i), F.lit("")).alias("name"), F.get(attributes, i).alias("attributes")))


def zip_links(trace_ids: Column, span_ids: Column, states: Column, attributes: Column) -> Column:
    return F.transform(span_ids, lambda s, i: F.struct(
        F.coalesce(F.get(trace_ids, i), F.lit("")).alias("trace_id"), s.alias("span_id"),
        F.coalesce(F.get(states, i), F.lit("")).alias("trace_state"), F.get(attributes, i).alias("attributes")))


def is_error() -> Column:
    return F.col("status_code") == "Error"


# --- filtering ----------------------------------------------------------------

@dataclass(frozen=True)
class SpanFilter:
    range: TimeRange | None = None
    service: str | None = None
    span_name: str | None = None
    kinds: tuple[str, ...] = ()
    error_only: bool = False
    min_duration_ns: int | None = None
    max_duration_ns: int | None = None
    attrs: tuple[AttrFilter, ...] = ()
    resource_attrs: tuple[AttrFilter, ...] = ()
    dims: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unscoped_ms: int | None = UNSCOPED_MS

    def validate(self) -> "SpanFilter":
        if self.range is None:
            raise ValueError("a trace search needs a time range")
        if self.service is None and self.unscoped_ms is not None and self.range.span_ms > self.unscoped_ms:
            raise ValueError("choose a service for ranges over six hours")
        if None not in (self.min_duration_ns, self.max_duration_ns) and self.min_duration_ns > self.max_duration_ns:
            raise ValueError("the minimum duration exceeds the maximum")
        return self

    def entry_by_default(self) -> "SpanFilter":
        return self if self.kinds else replace(self, kinds=ENTRY_KINDS)

    def apply(self, df: DataFrame) -> DataFrame:
        self.validate()
        conds = [self.range.holds()]
        if self.service is not None:
            conds.append(F.col("service_name") == self.service)
        if self.span_name is not None:
            conds.append(F.col("span_name") == self.span_name)
        if self.kinds:
            conds.append(F.col("span_kind").isin(list(self.kinds)))
        if self.error_only:
            conds.append(is_error())
        if self.min_duration_ns is not None:
            conds.append(F.col("duration_ns") >= self.min_duration_ns)
        if self.max_duration_ns is not None:
            conds.append(F.col("duration_ns") <= self.max_duration_ns)
        conds += [a.holds(df, "span_attributes") for a in self.attrs]
        conds += [a.holds(df, "resource_attributes") for a in self.resource_attrs]
        conds += [F.col(check_dimension(df, SPAN_COLUMNS, n)).isin(list(v)) for n, v in self.dims.items() if v]
        for c in conds:
            df = df.where(c)
        return df


# --- search and summaries --------------------------------------------------------

def dedupe_spans(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per (trace, span): the earliest of its retried copies. Copies are dropped before they are shuffled, and
    columns that nobody asks for are not read."""
    keep = [c for c in (columns or df.columns) if c not in ("trace_id", "span_id")]
    first = Window.partitionBy("trace_id", "span_id").orderBy("timestamp", "duration_ns", "service_name", "span_name", "status_code")
    return df.withColumn("__copy", F.row_number().over(first)).where("__copy = 1").select("trace_id", "span_id", *keep)


def candidate_traces(df: DataFrame, f: SpanFilter, sort: str = "time", n: int = 50) -> DataFrame:
    """The ``n`` traces whose newest (or slowest, ties newer) matching span ranks first:
    ``trace_id, ts_ms, rank_ns``."""
    hits = f.apply(df)
    if sort == "time":
        best = hits.groupBy("trace_id").agg(F.max(millis()).alias("ts_ms"), F.lit(None).cast("bigint").alias("rank_ns"))
        order = [F.desc("ts_ms"), F.asc("trace_id")]
    elif sort == "duration":
        best = (hits.groupBy("trace_id").agg(F.max(F.struct("duration_ns", millis().alias("ts_ms"))).alias("b"))
                    .select("trace_id", "b.ts_ms", F.col("b.duration_ns").alias("rank_ns")))
        order = [F.desc("rank_ns"), F.desc("ts_ms"), F.asc("trace_id")]
    else:
        raise ValueError(f"sort must be time or duration, not {sort!r}")
    return best.orderBy(*order).limit(n)


def trace_summaries(df: DataFrame) -> DataFrame:
    """One row per trace.  Copies of a span count once; the root is the earliest span
    without a parent, and the earliest span stands in when there is none."""
    one = dedupe_spans(df, ["timestamp", "parent_span_id", "duration_ns", "service_name", "span_name", "status_code"])
    us = F.unix_micros("timestamp")
    root = F.col("parent_span_id") == ""
    who = F.struct(F.col("service_name").alias("service"), F.col("span_name").alias("name"), "duration_ns")
    order = F.struct(us, "span_id")
    agg = one.groupBy("trace_id").agg(
        F.min(us).alias("start_us"),
        (F.max(us * 1000 + F.col("duration_ns")) - F.min(us) * 1000).alias("span_ns"),
        F.count("*").alias("span_count"),
        F.count_if(is_error()).alias("error_count"),
        F.count_if(root).alias("root_count"),
        F.min_by(F.when(root, who), F.when(root, order)).alias("root"),
        F.max(F.when(root, F.col("duration_ns"))).alias("root_ns"),
        F.min_by(who, order).alias("first"),
        F.sort_array(F.collect_set("service_name")).alias("services"))
    lost = F.col("root_count") == 0
    return agg.select(
        "trace_id", "start_us", F.greatest("span_ns", F.lit(0)).alias("span_ns"), "span_count", "error_count",
        F.when(lost, F.col("first.duration_ns")).otherwise(F.col("root_ns")).alias("duration_ns"),
        F.when(lost, F.col("first.service")).otherwise(F.col("root.service")).alias("root_service"),
        F.when(lost, F.col("first.name")).otherwise(F.col("root.name")).alias("root_name"),
        lost.alias("root_missing"), "services")


def search_traces(df: DataFrame, f: SpanFilter, sort: str = "time", n: int = 50) -> DataFrame:
    """Candidates, then their summaries over the range plus ten minutes, as one plan.
    The candidate list has at most ``n`` rows; adaptive execution broadcasts it while that is small."""
    found = candidate_traces(df, f, sort, n)
    near = df.where(f.range.widen(SUMMARY_PAD_MS).holds())
    summaries = trace_summaries(near.join(found.select("trace_id"), "trace_id", "left_semi"))
    out = found.join(summaries, "trace_id")
    if sort == "time":
        return out.orderBy(F.desc("ts_ms"), "trace_id")
    return out.orderBy(F.desc("rank_ns"), F.desc("ts_ms"), "trace_id")


# --- one trace ----------------------------------------------------------------------

LIGHT_COLUMNS = ("trace_id", "span_id", "parent_span_id", "service_name", "span_name", "span_kind", "start_us",
                 "duration_ns", "status_code", "status_message", "scope_name", "scope_version", "trace_state")


def span_light_columns(df: DataFrame) -> DataFrame:
    """Waterfall columns: no attribute column is read."""
    extras = [c for c in df.columns if c not in SPAN_COLUMNS]
    return df.withColumn("start_us", F.unix_micros("timestamp")).select(
        *LIGHT_COLUMNS, F.transform("events", lambda e: F.unix_micros(e["timestamp"])).alias("event_ts"),
        F.col("events.name").alias("event_names"), F.col("links.trace_id").alias("link_trace_ids"),
        F.col("links.span_id").alias("link_span_ids"), *extras)


def span_full_columns(df: DataFrame) -> DataFrame:
    """Everything of a span, attributes flattened to dotted keys."""
    extras = [c for c in df.columns if c not in SPAN_COLUMNS]
    return df.withColumn("start_us", F.unix_micros("timestamp")).select(
        *LIGHT_COLUMNS, flatten_attributes(df, "span_attributes").alias("attributes"),
        flatten_attributes(df, "resource_attributes").alias("resource"), "events", "links", *extras)


def trace_spans(df: DataFrame, trace_id: str, cap: int | None = None) -> DataFrame:
    """Spans of one trace in start order, at most ``cap`` (all if None); ``truncated`` says there were more."""
    mine = df.where(F.col("trace_id") == trace_id)
    light = [c for c in df.columns if c not in ("span_attributes", "resource_attributes")]
    one = dedupe_spans(mine, light)
    if cap is None:
        return span_light_columns(one.orderBy("timestamp", "span_id")).withColumn("truncated", F.lit(False))
    total = mine.agg(F.count_distinct("span_id").alias("n"))
    return (span_light_columns(one.orderBy("timestamp", "span_id").limit(cap))
            .withColumn("truncated", total.scalar() > cap))


def span_detail(df: DataFrame, trace_id: str, span_id: str) -> DataFrame:
    return span_full_columns(dedupe_spans(df.where((F.col("trace_id") == trace_id) & (F.col("span_id") == span_id))))


# Windows around a moment, (before, after) in ms, narrow to wide, and
# the ones that reach forward when a wide one holds too many spans.
WINDOWS = ((MINUTE, MINUTE), (15 * MINUTE, 15 * MINUTE), (HOUR, DAY), None)
FORWARD = ((MINUTE, 2 * HOUR), (MINUTE, 30 * MINUTE), (MINUTE, 5 * MINUTE))
NOW_WINDOWS = ((15 * MINUTE, 15 * MINUTE), (2 * HOUR, 2 * HOUR), (26 * HOUR, 26 * HOUR), None)
EVER = 1 << 62


def _window_struct(before_after, truncated: bool, narrowed: bool) -> Column:
    before, after = before_after or (EVER, EVER)
    return F.struct(F.lit(before).cast("bigint").alias("before_ms"), F.lit(after).cast("bigint").alias("after_ms"),
                    F.lit(truncated).alias("truncated"), F.lit(narrowed).alias("narrowed"))


def trace_windows(df: DataFrame, anchors: DataFrame, cap: int | None = None, now_ms: int | None = None) -> DataFrame:
    """Which part of each trace to show.  ``anchors``: ``trace_id, at_ms``; a trace without
    a moment is looked for around ``now_ms`` in wider windows, without the forward ones.
    Without a ``cap`` no window holds too many spans."""
    cap = EVER if cap is None else cap
    if now_ms is None:
        return _windows(df, anchors, cap, WINDOWS, FORWARD)
    known, unknown = anchors.where("at_ms is not null"), anchors.where("at_ms is null").withColumn("at_ms", F.lit(now_ms).cast("bigint"))
    return _windows(df, known, cap, WINDOWS, FORWARD).unionByName(_windows(df, unknown, cap, NOW_WINDOWS, ()))


def _windows(df: DataFrame, anchors: DataFrame, cap: int, wide: tuple, forward: tuple) -> DataFrame:
    """The windows of ``wide`` (last: all times), and longer ones to the future.

    Every candidate window is measured in one aggregation; the choice is then a
    chain of conditions.  A window is enough when its spans keep a tenth of its
    width clear of both edges.  One that holds more than ``cap`` spans gives way to
    the longest forward window that fits, else to the narrowest useful one."""
    offset = millis() - F.col("at_ms")
    rows = (df.select("trace_id", "span_id", "timestamp").join(anchors, "trace_id")
              .groupBy("trace_id", "at_ms", "span_id").agg(F.min(offset).alias("off")))
    aggs = []
    for name, windows in (("w", wide), ("f", forward)):
        for i, w in enumerate(windows):
            inside = F.lit(True) if w is None else (
                (F.col("off") >= F.greatest(F.lit(-w[0]), -F.col("at_ms"))) & (F.col("off") < w[1]))
            aggs += [F.count_if(inside).alias(f"{name}{i}_n"), F.min(F.when(inside, F.col("off"))).alias(f"{name}{i}_lo"),
                     F.max(F.when(inside, F.col("off"))).alias(f"{name}{i}_hi")]
    m = rows.groupBy("trace_id", "at_ms").agg(*aggs)

    def n(i, kind="w"):
        return F.col(f"{kind}{i}_n")

    def enough(i):
        before, after = wide[i]
        margin = max(1, (before + after) // 10)
        start = F.greatest(F.lit(-before), -F.col("at_ms"))
        return (n(i) > 0) & (F.col(f"w{i}_lo") - start >= margin) & (F.lit(after) - F.col(f"w{i}_hi") >= margin)

    def fallback(i):
        """What to show when window ``i`` holds too many spans."""
        out = None
        for j, w in enumerate(forward):
            if wide[i] is None or w[1] <= wide[i][1]:
                fits = (n(j, "f") > 0) & (n(j, "f") <= cap)
                pick = _window_struct(w, True, True)
                out = F.when(fits, pick) if out is None else out.when(fits, pick)
        for j in range(i):
            useful = (n(j) > 0) & (n(j) * 10 >= cap)
            pick = _window_struct(wide[j], True, True)
            out = F.when(useful, pick) if out is None else out.when(useful, pick)
        plain = _window_struct(wide[i], True, False)
        return plain if out is None else out.otherwise(plain)

    def widest(upto):
        out = None
        for j in reversed(range(upto)):
            pick = _window_struct(wide[j], False, False)
            out = F.when(n(j) > 0, pick) if out is None else out.when(n(j) > 0, pick)
        return out

    choice = None
    for i in range(3):
        for cond, pick in ((n(i) > cap, fallback(i)), (enough(i), _window_struct(wide[i], False, False))):
            choice = F.when(cond, pick) if choice is None else choice.when(cond, pick)
    last_n = F.coalesce(*[F.when(n(j) > 0, n(j)) for j in (2, 1, 0)], F.lit(0))
    choice = choice.when(last_n * 2 > cap, widest(3)).when(n(3) > cap, fallback(3)).otherwise(widest(4))
    return m.select("trace_id", "at_ms", choice.alias("w")).select("trace_id", "at_ms", "w.*")


def clip_traces(df: DataFrame, windows: DataFrame, cap: int | None = None) -> DataFrame:
    """Unique spans inside the chosen windows, the first ``cap`` (all if None) where a window overflows."""
    cols = [c for c in df.columns if c not in ("span_attributes", "resource_attributes")]
    off = millis() - F.col("at_ms")
    inside = (df.select(*cols).join(windows, "trace_id")
                .where((F.col("before_ms") == EVER) | ((off >= -F.col("before_ms")) & (off < F.col("after_ms")))))
    one = dedupe_spans(inside)
    if cap is None:
        return one
    overflow = F.col("truncated") & ~F.col("narrowed")
    # only overflowing traces are counted off: they are the big ones
    cut = row_position(one.where(overflow), ["trace_id"], ["timestamp", "span_id"], "place").where(F.col("place") <= cap).drop("place")
    return one.where(~overflow).unionByName(cut)


def pin_spans(shown: DataFrame, df: DataFrame, pins: DataFrame) -> DataFrame:
    """Add requested spans (``trace_id, span_id``) that a cut left out."""
    wanted = dedupe_spans(df.join(pins, ["trace_id", "span_id"], "left_semi"),
                          [c for c in shown.columns if c in df.columns])
    lost = wanted.join(shown.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti")
    return (shown.withColumn("pinned", F.lit(False))
            .unionByName(lost.withColumn("pinned", F.lit(True)), allowMissingColumns=True))


# --- lists and samples ------------------------------------------------------------------

def _top_values(df: DataFrame, value: Column, limit: int | None) -> DataFrame:
    return at_most(df.groupBy(value.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value"), limit)


def list_services(df: DataFrame, rng: TimeRange, limit: int | None = None) -> DataFrame:
    return _top_values(df.where(rng.holds()), F.col("service_name"), limit)


def list_span_names(df: DataFrame, rng: TimeRange, service: str, kinds=(), limit: int | None = None) -> DataFrame:
    rows = df.where(rng.holds()).where(F.col("service_name") == service)
    return _top_values(rows.where(F.col("span_kind").isin(list(kinds))) if kinds else rows, F.col("span_name"), limit)


def _of_service(df: DataFrame, rng: TimeRange, service: str) -> DataFrame:
    if not (service or "").strip():
        raise ValueError("attribute lists need a service")
    return df.where(rng.holds()).where(F.col("service_name") == service)


def attr_keys(df: DataFrame, rng: TimeRange, service: str, column: str = "span_attributes",
              limit: int | None = None) -> DataFrame:
    """Attribute names on one service's spans, with the number of spans that have them."""
    names = _of_service(df, rng, service).select(F.explode(attr_names(df, column)).alias("key"))
    return at_most(names.groupBy("key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key"), limit)


def attr_values(df: DataFrame, rng: TimeRange, service: str, key: str, column: str = "span_attributes",
                limit: int | None = None) -> DataFrame:
    rows = _of_service(df, rng, service).select(attr(df, column, key).alias("value"))
    return _top_values(rows.where("value <> ''"), F.col("value"), limit)


# --- heat map and error groups -----------------------------------------------------------

def latency_heatmap(df: DataFrame, f: SpanFilter, tz: str = "UTC", bins: int = HEATMAP_BINS,
                    max_buckets: int = SPAN_BUCKETS) -> DataFrame:
    """Span counts per time bucket and logarithmic duration level.  Level ``l`` covers
    ``[10^(l/bins), 10^((l+1)/bins))`` ms; everything up to a microsecond shares the lowest."""
    f = f.entry_by_default()
    b = Bucket.choose(f.range, tz, max_buckets)
    lvl = F.greatest(F.floor(F.log10(F.greatest(F.col("duration_ns"), F.lit(1)) / 1_000_000) * bins), F.lit(-3 * bins))
    return (f.apply(df).groupBy(b.index().alias("bucket"), lvl.cast("int").alias("lvl"))
             .agg(F.count("*").alias("count"), F.count_if(is_error()).alias("errors"))
             .select(b.start(F.col("bucket")).alias("t_ms"), "lvl", "count", "errors"))


def heatmap_totals(cells: DataFrame) -> DataFrame:
    return cells.agg(F.sum("count").alias("total"), F.max("count").alias("max_count"))


def error_groups(df: DataFrame, rng: TimeRange, kind: str = "entry", service: str | None = None,
                 span_name: str | None = None, message_chars: int | None = None) -> DataFrame:
    """Failed spans gathered by what went wrong, all groups.  Messages are grouped whole
    unless ``message_chars`` shortens them (screens use ERROR_MESSAGE_CHARS)."""
    if kind not in KIND_GROUPS:
        raise ValueError(f"kind must be one of {sorted(KIND_GROUPS)}, not {kind!r}")
    rows = df.where(rng.holds()).where(is_error())
    if KIND_GROUPS[kind]:
        rows = rows.where(F.col("span_kind").isin(list(KIND_GROUPS[kind])))
    if service is not None:
        rows = rows.where(F.col("service_name") == service)
    if span_name is not None:
        rows = rows.where(F.col("span_name") == span_name)
    keyed = rows.select(
        "service_name", "span_kind", "span_name", event_attr(df, "exception.type").alias("exc_type"),
        head(event_attr(df, "exception.message"), message_chars).alias("exc_msg"),
        attr(df, "span_attributes", "http.response.status_code").alias("http_status"),
        attr(df, "span_attributes", "server.address").alias("peer"), "trace_id", "span_id", millis().alias("ts_ms"))
    # per (group, trace) first: the distinct count needs no second copy of the rows and
    # a group holding most errors is spread over its traces
    per_trace = keyed.groupBy(*ERROR_GROUP_KEYS, "trace_id").agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max(F.struct("ts_ms", "span_id")).alias("newest"))
    return per_trace.groupBy(*ERROR_GROUP_KEYS).agg(
        F.sum("n").alias("count"), F.count("*").alias("traces"), F.min("first_ms").alias("first_ms"),
        F.max(F.struct(F.col("newest.ts_ms").alias("ts"), "trace_id", F.col("newest.span_id").alias("span_id"))).alias("s"),
    ).select(F.concat_ws("\x1f", *ERROR_GROUP_KEYS).alias("group_id"), *ERROR_GROUP_KEYS, "count", "traces", "first_ms",
             F.col("s.ts").alias("last_ms"), F.col("s.trace_id").alias("sample_trace"), F.col("s.span_id").alias("sample_span"))


def top_error_groups(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """Largest groups first, each with the error total of *all* groups."""
    top = at_most(groups.orderBy(F.desc("count"), "service_name", "group_id"), limit)
    return top.withColumn("total", groups.agg(F.sum("count").alias("t")).scalar())


def top_error_per_service(groups: DataFrame) -> DataFrame:
    w = Window.partitionBy("service_name").orderBy(F.desc("count"), "group_id")
    return groups.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def error_group_search(groups: DataFrame, text: str) -> DataFrame:
    needle = text.strip().lower()
    if not needle:
        return groups
    hit = F.lit(False)
    for c in ("service_name", "span_name", "exc_type", "exc_msg", "http_status", "peer"):
        hit = hit | contains_ci(F.col(c), needle)
    return groups.where(hit)
