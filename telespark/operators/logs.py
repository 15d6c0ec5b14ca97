"""Log search, histograms, facets and context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions import keywords as kw
from telespark.functions.lineage import materialize
from telespark.functions.ordered import running_total
from telespark.functions.limits import at_most, at_most_per
from telespark.functions.maths import head
from telespark.functions.timeaxis import HOUR, LOG_BUCKETS, Bucket, TimeRange, dense, instant, millis
from telespark.sources.schema import LOG_COLUMNS, check_dimension, column_kind

MESSAGE_CAP = 16_384
MAX_OFFSET = 10_000
CONTEXT_MS = HOUR
# Fixed value: severity order of level names.
LEVELS = ("FATAL", "ERROR", "WARN", "WARNING", "INFO", "DEBUG", "TRACE")
NOT_FACETABLE = ("message", "file", "trace_id", "span_id", "timestamp")


def level_rank(level: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), F.upper(level)), F.lit(0)) - 1,
                      F.lit(len(LEVELS)))


@dataclass(frozen=True)
class LogFilter:
    range: TimeRange | None = None
    q: str = ""
    regex: bool = False
    levels: tuple[str, ...] = ()
    logger: str | None = None
    thread: str | None = None
    host: str | None = None
    trace_id: str | None = None
    span_id: str | None = None
    dims: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def unscoped(self) -> bool:
        return self.trace_id is None and not self.dims.get("service_name")

    def validate(self) -> "LogFilter":
        if self.range is None and self.trace_id is None and self.span_id is None:
            raise ValueError("a time range is needed unless trace_id or span_id is given")
        if self.regex and len(self.q.encode()) > kw.MAX_REGEX_BYTES:
            raise ValueError(f"a regular expression is limited to {kw.MAX_REGEX_BYTES} bytes")
        return self

    def expression(self):
        return None if self.regex else kw.parse(self.q)

    def highlights(self) -> dict[str, list[str]]:
        """Words to highlight, and those of them matched as whole tokens."""
        e = self.expression()
        return {"terms": kw.positive_terms(e), "token_terms": kw.token_terms(e, self.unscoped) if e else []}

    def clauses(self, df: DataFrame) -> dict[str, Column]:
        """One predicate per filtered column, cheap ones first."""
        out: dict[str, Column] = {}
        if self.range:
            out["timestamp"] = self.range.holds()
        for name in ("trace_id", "span_id", "host"):
            if getattr(self, name) is not None:
                out[name] = F.col(name) == getattr(self, name)
        if self.levels:
            out["level"] = F.col("level").isin([v.upper() for v in self.levels])
        for name, values in self.dims.items():
            if values:
                out[check_dimension(df, LOG_COLUMNS, name)] = F.col(name).isin(list(values))
        for name in ("logger", "thread"):
            if getattr(self, name) is not None:
                out[name] = kw.contains_ci(F.col(name), getattr(self, name))
        if self.q.strip():
            e = self.expression()
            if self.regex:
                out["message"] = F.col("message").rlike(self.q.strip())
            elif e is not None:
                out["message"] = kw.predicate(e, F.col("message"), self.unscoped)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        self.validate()
        for c in self.clauses(df).values():
            df = df.where(c)
        return df


def log_order(order: str = "desc") -> list[Column]:
    """(timestamp, level, trace_id); the rest only decides between equal rows, so that
    pages are stable."""
    if order not in ("asc", "desc"):
        raise ValueError(f"order must be asc or desc, not {order!r}")
    cols = [F.col("timestamp"), F.col("level"), F.col("trace_id"),
            *map(F.col, ("host", "file", "thread", "logger", "span_id", "message"))]
    return [c.desc() if order == "desc" else c.asc() for c in cols]


def log_columns(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Fixed columns plus displayable extras.  ``message`` keeps its first ``cap``
    characters (all without a cap) and ``message_len`` its full length."""
    extras = [f.name for f in df.schema.fields
              if f.name not in LOG_COLUMNS and column_kind(f.dataType) in ("string", "int", "float", "datetime")]
    message = [head(F.col("message"), cap).alias("message"), F.char_length("message").cast("bigint").alias("message_len")]
    return df.select(millis().alias("ts_ms"), "level", "trace_id", "span_id", "thread", "logger",
                     *message, "file", "host", *extras)


def search_logs(df: DataFrame, f: LogFilter, order: str = "desc", limit: int = 100, offset: int = 0,
                cap: int | None = None) -> DataFrame:
    if offset > MAX_OFFSET:
        raise ValueError(f"offset is limited to {MAX_OFFSET}; narrow the time range instead")
    rows = f.apply(df).orderBy(*log_order(order))
    return log_columns((rows.offset(offset) if offset else rows).limit(limit), cap)


def count_logs(df: DataFrame, f: LogFilter) -> DataFrame:
    return f.apply(df).agg(F.count("*").alias("count"))


def search_with_total(df: DataFrame, f: LogFilter, **page) -> DataFrame:
    """A page of rows, each with the exact number of matches before the limit."""
    return search_logs(df, f, **page).withColumn("total", count_logs(df, f).scalar())


def log_histogram(df: DataFrame, f: LogFilter, tz: str = "UTC", max_buckets: int = LOG_BUCKETS) -> DataFrame:
    """``t_ms, level, level_rank, count`` with every bucket present for every level seen."""
    if f.range is None:
        raise ValueError("a histogram needs a time range")
    b = Bucket.choose(f.range, tz, max_buckets)
    counts = f.apply(df).groupBy(b.index().alias("bucket"), "level").agg(F.count("*").alias("count"))
    levels = counts.select("level").distinct()
    return (dense(b, f.range, counts, levels, zero=["count"])
            .select(b.start(F.col("bucket")).alias("t_ms"), "level", level_rank(F.col("level")).alias("level_rank"), "count"))


def histogram_total(histogram: DataFrame) -> DataFrame:
    return histogram.agg(F.sum("count").alias("total"))


def check_facets(df: DataFrame, fields) -> list[str]:
    if not fields:
        raise ValueError("name at least one field")
    for name in fields:
        if name in NOT_FACETABLE or name not in df.columns or column_kind(df.schema[name].dataType) != "string":
            raise ValueError(f"values of {name!r} cannot be counted")
    return list(fields)


def _explode_values(df: DataFrame, pairs: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*pairs)))


def log_facets(df: DataFrame, f: LogFilter, fields, k: int | None = None, exact: bool = True) -> DataFrame:
    """Top ``k`` values of many columns in one scan: ``field, value, count``.

    Exact mode counts (field, value) pairs with map-side partial sums.  The
    approximate mode keeps a bounded sketch per field, so its memory does not
    depend on how many distinct values there are.
    """
    fields = check_facets(df, fields)
    rows = f.apply(df)
    if exact:
        pairs = [F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in fields]
        counts = _explode_values(rows, pairs).groupBy("field", "value").agg(F.count("*").alias("count"))
        return at_most_per(counts, ["field"], [F.desc("count"), F.asc("value")], k)
    if k is None:
        raise ValueError("the approximate mode needs k")
    tops = rows.agg(*[F.expr(f"approx_top_k(`{n}`, {int(k)}, {max(10_000, 4 * int(k))})").alias(n) for n in fields])
    pairs = [F.struct(F.lit(n).alias("field"), F.col(n).alias("top")) for n in fields]
    return (tops.select(F.inline(F.array(*pairs))).select("field", F.inline("top"))
                .select("field", F.col("item").alias("value"), "count"))


def cross_filter_facets(df: DataFrame, selected: dict[str, Column], rank_levels: bool = True) -> DataFrame:
    """Value counts per column with the filters of every *other* column applied.

    ``selected`` maps a column to its own filter (``lit(True)`` for none).  One
    scan: each row yields one (field, value) pair per column whose other filters
    it passes."""
    pairs = []
    for name in selected:
        others = F.lit(True)
        for other, cond in selected.items():
            if other != name:
                others = others & F.coalesce(cond, F.lit(False))
        pairs.append(F.struct(F.lit(name).alias("field"), F.coalesce(F.col(name), F.lit("")).alias("value"),
                              others.alias("keep")))
    counts = (_explode_values(df, pairs).where("keep").groupBy("field", "value").agg(F.count("*").alias("count")))
    if rank_levels:
        counts = counts.withColumn("rank", F.when(F.col("field") == "level", level_rank(F.col("value"))).otherwise(0))
        return counts.orderBy("field", "rank", F.desc("count"), "value")
    return counts.orderBy("field", F.desc("count"), "value")


def log_context(df: DataFrame, host: str, file: str, ts_ms: int, n: int = 50, cap: int | None = None) -> DataFrame:
    """``n`` lines of one stream at or before a moment and ``n`` after it, within an hour."""
    stream = df.where((F.col("host") == host) & (F.col("file") == file))
    at = instant(ts_ms + 1)      # "at" includes the whole millisecond
    before = (stream.where((F.col("timestamp") >= instant(ts_ms - CONTEXT_MS)) & (F.col("timestamp") < at))
                    .orderBy(*log_order("desc")).limit(n))
    after = (stream.where((F.col("timestamp") >= at) & (F.col("timestamp") < instant(ts_ms + CONTEXT_MS)))
                   .orderBy(*log_order("asc")).limit(n))
    return (log_columns(before, cap).withColumn("side", F.lit("before"))
            .unionByName(log_columns(after, cap).withColumn("side", F.lit("after"))))


def log_context_batch(df: DataFrame, anchors: DataFrame, n: int = 50) -> DataFrame:
    """Context of many moments at once.  ``anchors`` has ``anchor_id, host, file, ts_ms``.

    Lines get a position in their (host, file) stream; an anchor gets the number
    of lines at or before it and then asks for the ``2 n`` positions around that
    number.  Work is linear in lines plus output: no line is paired with an anchor
    that does not return it, and streams of any size are cut into ranges.  Only lines
    between an hour before the first and an hour after the last anchor are read, and they
    are shuffled once.
    """
    keys = ["host", "file"]
    anchors = materialize(anchors.select("anchor_id", *keys, "ts_ms"))
    low, high = anchors.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    near = df.where(TimeRange(max(0, low - CONTEXT_MS), high + CONTEXT_MS + 1).holds()) if low is not None else df.where("false")
    lines = near.select(*keys, "timestamp", millis().alias("ts_ms"), "level", "trace_id", "span_id", "message",
                        F.xxhash64("host", "file", "thread", "logger", "span_id", "message").alias("tie"))
    marks = anchors
    # position of lines, and lines-so-far at each anchor, from one ordered pass
    both = (lines.select(*keys, "ts_ms", "timestamp", "level", "trace_id", "tie", F.lit(0).alias("mark"),
                         F.lit(None).cast(anchors.schema["anchor_id"].dataType).alias("anchor_id"), "span_id", "message")
            .unionByName(marks.select(*keys, "ts_ms", F.timestamp_millis("ts_ms").alias("timestamp"), F.lit("").alias("level"),
                                      F.lit("").alias("trace_id"), F.lit(0).cast("bigint").alias("tie"),
                                      F.lit(1).alias("mark"), "anchor_id", F.lit("").alias("span_id"), F.lit("").alias("message"))))
    order = ["ts_ms", "mark", "timestamp", "level", "trace_id", "tie"]
    placed = running_total(both, keys, order, F.lit(1) - F.col("mark"), "pos")
    wanted = (placed.where("mark = 1")
              .select("anchor_id", *keys, F.col("ts_ms").alias("anchor_ms"), F.col("pos").alias("at"),
                      F.explode(F.sequence(F.col("pos") - n + 1, F.col("pos") + n)).alias("pos"))
              .where("pos > 0"))
    rows = placed.where("mark = 0").select(*keys, "pos", "ts_ms", "level", "trace_id", "span_id", "message")
    return (wanted.join(rows, [*keys, "pos"])
            .where(F.when(F.col("pos") <= F.col("at"), F.col("ts_ms") >= F.col("anchor_ms") - CONTEXT_MS)
                    .otherwise(F.col("ts_ms") < F.col("anchor_ms") + CONTEXT_MS))
            .select("anchor_id", *keys, "anchor_ms", "ts_ms", "level", "trace_id", "span_id", "message",
                    F.when(F.col("pos") <= F.col("at"), "before").otherwise("after").alias("side"),
                    F.when(F.col("pos") <= F.col("at"), F.col("at") - F.col("pos") + 1)
                     .otherwise(F.col("pos") - F.col("at")).alias("distance")))


def logs_for_trace(logs: DataFrame, spans: DataFrame, pad_ms: int = HOUR) -> DataFrame:
    """Log lines of the traces in ``spans``, within each trace's extent plus ``pad_ms``."""
    extent = spans.groupBy("trace_id").agg(
        F.min(millis()).alias("first_ms"),
        F.max(F.floor((F.unix_micros("timestamp") + F.col("duration_ns") / 1000) / 1000)).alias("last_ms"))
    return (logs.where(F.col("trace_id") != "").join(extent, "trace_id")
            .where((F.col("timestamp") >= F.timestamp_millis(F.greatest(F.col("first_ms") - pad_ms, F.lit(0))))
                   & (F.col("timestamp") < F.timestamp_millis(F.col("last_ms") + pad_ms))))


def shape_log_row(rows: DataFrame, tz: str = "UTC", max_chars: int = 1000) -> DataFrame:
    """Compact form of ``log_columns`` output: readable time, shortened message with
    its full length, and a map of the non-empty remaining string columns."""
    fields = [f.name for f in rows.schema.fields
              if column_kind(f.dataType) == "string" and f.name not in ("message",)]
    full = F.col("message_len") if "message_len" in rows.columns else F.char_length("message").cast("bigint")
    seen = F.char_length("message")
    cut = F.when(seen > max_chars, F.concat(F.substring("message", 1, max_chars), F.lit("… ["), seen.cast("string"),
                                            F.lit(" characters, cut]"))).otherwise(F.col("message"))
    pairs = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(F.col(c), F.lit("")) for c in fields]))
    return rows.select(
        "ts_ms",
        F.date_format(F.from_utc_timestamp(F.timestamp_millis("ts_ms"), tz), "yyyy-MM-dd HH:mm:ss.SSS").alias("time"),
        cut.alias("message"), full.alias("message_len"),
        F.map_filter(pairs, lambda _, v: v != "").alias("fields"))


def export_logs(df: DataFrame, f: LogFilter, order: str = "desc", limit: int | None = None, tz: str = "UTC") -> DataFrame:
    """Rows for a file: full messages, time as text."""
    rows = log_columns(at_most(f.apply(df).orderBy(*log_order(order)), limit)).drop("message_len")
    when = F.date_format(F.from_utc_timestamp(F.timestamp_millis("ts_ms"), tz), "yyyy-MM-dd HH:mm:ss.SSS")
    return rows.select(when.alias("time"), *[c for c in rows.columns if c != "ts_ms"])
