"""Database calls inside traces, statement filling, source matching and digests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.functions.attrs import attr, first_attr, flatten_attributes
from telespark.functions.limits import at_most, at_most_per
from telespark.functions.maths import head, quantiles
from telespark.functions.timeaxis import millis
from telespark.operators.traces import SpanFilter, dedupe_spans, is_error

# Attribute spellings of old and new conventions, best first.
DB_ATTRIBUTES = {
    "db_system": ("db.system.name", "db.system"),
    "db_name": ("db.namespace", "db.name", "db.redis.database_index"),
    "db_operation": ("db.operation.name", "db.operation"),
    "db_collection": ("db.collection.name", "db.sql.table"),
    "db_server": ("server.address", "net.peer.name"),
    "db_port": ("server.port", "net.peer.port"),
}
STATEMENT_ATTRIBUTES = ("db.query.text", "db.statement")
PARAMS_ATTRIBUTE = "db.query.parameter"          # one attribute with all, or the head of one for each
SORTS = ("total", "p95", "max", "calls", "errors")
# Which registered source type serves a db.system value.
SOURCE_TYPES = {
    "mysql": "mysql", "mariadb": "mysql", "tidb": "mysql", "other_sql": "mysql", "redis": "redis",
    "elasticsearch": "elasticsearch", "opensearch": "elasticsearch", "clickhouse": "clickhouse",
}


def _db_columns(df: DataFrame, chars: int | None) -> list[Column]:
    cols = [first_attr(df, "span_attributes", keys).alias(name) for name, keys in DB_ATTRIBUTES.items()]
    return [*cols, head(first_attr(df, "span_attributes", STATEMENT_ATTRIBUTES), chars).alias("statement")]


def trace_db_calls(df: DataFrame, chars: int | None = None, with_params: bool = False) -> DataFrame:
    """Client spans that name a database system, with unified columns."""
    params = [_params(df).alias("params")] if with_params else []
    rows = df.where(F.col("span_kind") == "Client").select(
        "trace_id", "span_id", "parent_span_id", "timestamp", "service_name", "span_name", "duration_ns", "status_code",
        "status_message", *_db_columns(df, chars), *params).where("db_system <> ''")
    return dedupe_spans(rows).withColumn("start_us", F.unix_micros("timestamp")).drop("timestamp")


def _params(df: DataFrame) -> Column:
    """Query parameters as JSON text: from ``db.query.parameter.<key>`` attributes, else
    from one attribute that holds them all."""
    head_of = PARAMS_ATTRIBUTE + "."
    family = F.map_filter(flatten_attributes(df, "span_attributes"), lambda k, v: k.startswith(head_of))
    family = F.transform_keys(family, lambda k, _: F.substring(k, len(head_of) + 1, (1 << 31) - 1))
    return F.when(F.size(family) > 0, F.to_json(family)).otherwise(attr(df, "span_attributes", PARAMS_ATTRIBUTE))


def params_in_order(params: Column) -> Column:
    """JSON object of parameters as an array of texts in index order."""
    entries = F.map_entries(F.from_json(params, "map<string,string>"))
    keyed = F.transform(entries, lambda e: F.struct(
        F.coalesce(e["key"].try_cast("bigint"), F.lit(1 << 62)).alias("n"), e["key"].alias("k"),
        F.coalesce(e["value"], F.lit("NULL")).alias("v")))
    return F.coalesce(F.transform(F.array_sort(keyed), lambda e: e["v"]), F.array().cast("array<string>"))


_QUOTED = r"'(?:[^'\\]++|\\.|'')*+'?|\"(?:[^\"\\]++|\\.|\"\")*+\"?|`(?:[^`]++|``)*+`?"
_PLAIN = r"[^?'\"`]++"
_COMMENTS = r"--[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_PLAIN_OR_SLASH = r"[^?'\"`/\-]++|[/\-]"


def fill_statement(statement: Column, params: Column, display: bool = False) -> Column:
    """Put parameters in place of ``?`` outside quotes.

    Normally each becomes a quoted literal and a count mismatch gives NULL.  With
    ``display`` comments are skipped too, numbers stay bare and missing parameters
    leave the ``?``."""
    pattern = f"({_COMMENTS}|{_QUOTED}|\\?|{_PLAIN_OR_SLASH})" if display else f"({_QUOTED}|\\?|{_PLAIN})"
    parts = F.regexp_extract_all(statement, F.lit(pattern), 1)
    quoted = lambda v: F.concat(F.lit("'"), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    if display:
        number = lambda v: v.rlike(r"^-?\d+(\.\d+)?$") & ~v.rlike(r"^-?0\d")
        literal = lambda v: F.when(v.isNull(), "?").when(number(v), v).otherwise(quoted(v))
    else:
        literal = lambda v: F.coalesce(quoted(v), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    done = F.aggregate(parts, start, lambda acc, p: F.struct(
        F.concat(acc["out"], F.when(p == "?", literal(F.get(params, acc["used"]))).otherwise(p)).alias("out"),
        (acc["used"] + F.when(p == "?", 1).otherwise(0)).alias("used")))
    if display:
        return F.when((statement != "") & (F.size(params) > 0), done["out"])
    return F.when(done["used"] == F.size(params), done["out"])


def fill_statements(calls: DataFrame, display: bool = False) -> DataFrame:
    return calls.withColumn("filled", fill_statement(F.col("statement"), params_in_order(F.col("params")), display))


def repeated_statements(calls: DataFrame, least: int = 3, top: int | None = None) -> DataFrame:
    """Statements run at least ``least`` times inside one trace (the ``top`` worst of each by
    total time), with the trace's whole database time."""
    per = calls.groupBy("trace_id", "service_name", "statement").agg(
        F.count("*").alias("times"), F.sum("duration_ns").alias("total_ns"))
    whole = per.groupBy("trace_id").agg(F.sum("total_ns").alias("trace_db_ns"))
    often = at_most_per(per.where(F.col("times") >= least), ["trace_id"], [F.desc("total_ns"), "service_name", "statement"], top)
    return often.join(whole, "trace_id")


def db_calls_top(df: DataFrame, f: SpanFilter, system: str | None = None, sort: str = "total", limit: int | None = None,
                 chars: int | None = None) -> DataFrame:
    """Calls grouped by statement with the slowest one as a sample."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}, not {sort!r}")
    rows = f.apply(df).select("service_name", *_db_columns(df, chars), "duration_ns", "status_code", "trace_id", "span_id",
                              millis().alias("ts_ms")).where("db_system <> ''")
    if system is not None:
        rows = rows.where(F.col("db_system") == system.lower())
    keys = ["service_name", *DB_ATTRIBUTES, "statement"]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(is_error()).alias("errors"),
        quantiles(F.col("duration_ns"), (0.5, 0.95)).alias("q"), F.max("duration_ns").alias("max_ns"),
        F.sum("duration_ns").alias("total_ns"),
        F.max(F.struct("duration_ns", "ts_ms", "trace_id", "span_id")).alias("s"))
    out = out.select(*keys, "calls", "errors", F.col("q")[0].alias("p50_ns"), F.col("q")[1].alias("p95_ns"), "max_ns", "total_ns",
                     F.col("s.trace_id").alias("sample_trace"), F.col("s.span_id").alias("sample_span"),
                     F.col("s.ts_ms").alias("sample_ms"))
    by = {"total": "total_ns", "p95": "p95_ns", "max": "max_ns", "calls": "calls", "errors": "errors"}[sort]
    return at_most(out.orderBy(F.desc(by), *keys), limit)


@dataclass(frozen=True)
class Source:
    """A registered database: where it is and who uses it."""

    name: str
    kind: str
    host: str
    port: int | None = None
    database: str | None = None
    aliases: tuple[str, ...] = ()
    services: tuple[str, ...] = ()


def _addresses(s: Source):
    yield s.host.lower(), s.port
    for a in s.aliases:
        host, colon, port = a.rpartition(":")
        yield (host.lower(), int(port)) if colon and port.isdigit() else (a.lower(), None)


def match_source(calls: DataFrame, sources: list[Source]) -> DataFrame:
    """Add ``source`` and ``source_score``: host counts 4, database 2, service 1, another
    type rules a source out; ties go to the one registered first.

    The registry is configuration, so it travels as one constant array and is scored
    by a higher-order function: no join."""
    if not sources:
        return calls.withColumns({"source": F.lit(None).cast("string"), "source_score": F.lit(0)})
    kind = None
    for system, k in SOURCE_TYPES.items():
        cond = F.lower(F.trim("db_system")) == system
        kind = F.when(cond, k) if kind is None else kind.when(cond, k)
    port = F.col("db_port").try_cast("int")
    host = F.lower(F.trim("db_server"))
    registry = F.array(*[F.struct(
        F.lit(-i).alias("rank"), F.lit(s.name).alias("name"), F.lit(s.kind).alias("kind"),
        F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).cast("int").alias("port")) for h, p in _addresses(s)]).alias("at"),
        F.lit(s.database).cast("string").alias("database"),
        F.array(*map(F.lit, s.services)).cast("array<string>").alias("services")) for i, s in enumerate(sources)])

    def score(s):
        at_host = F.exists(s["at"], lambda a: (a["host"] == host) & (host != "")
                           & (a["port"].isNull() | port.isNull() | (a["port"] == port)))
        same_db = (F.col("db_name") != "") & F.coalesce(s["database"] == F.col("db_name"), F.lit(False))
        used_by = (F.col("service_name") != "") & F.array_contains(s["services"], F.col("service_name"))
        points = F.when(at_host, 4).otherwise(0) + F.when(same_db, 2).otherwise(0) + F.when(used_by, 1).otherwise(0)
        return F.struct(F.when(F.coalesce(s["kind"] == kind, F.lit(False)), points).otherwise(0).alias("score"),
                        s["rank"].alias("rank"), s["name"].alias("name"))

    best = F.array_max(F.transform(registry, score))
    return (calls.withColumn("__best", best)
            .withColumns({"source": F.when(F.col("__best.score") > 0, F.col("__best.name")), "source_score": F.col("__best.score")})
            .drop("__best"))


_NUMBER = r"[0-9][\w.]*+|\.[0-9]\w*+|\$[0-9]++"
_WORD = r"[\p{L}_][\p{L}\p{N}_$]*+"
_SPACE = r"(?:\s++|--[^\n]*+|/\*(?s:.*?)(?:\*/|\z))++"
_SIGNS, _MASKS = "(?", "\ue000\ue001"       # signs of quoted names while lists are looked for


def normalize_statement(statement: Column) -> Column:
    """Statement with literals, value lists, comments and spacing evened out.

    One pass cuts it into tokens: quoted texts and numbers become ``?``, white space and comments one blank, words
    and quoted names stay, so a digit in a name, a quote in a comment or a comment in a quote is what it is. Then lists of
    ``?`` become ``(?, ...)``, and rows of equal lists, as in ``in ((1, 2), (3, 4))`` or after ``values``, one of them."""
    tokens = F.regexp_extract_all(statement, F.lit(rf"(?s)({_SPACE}|{_QUOTED}|{_NUMBER}|{_WORD}|.)"), F.lit(1))
    first = lambda t: F.substring(t, 1, 1)
    even = F.transform(tokens, lambda t: F.when(t.rlike(rf"\A(?:{_SPACE})\z"), " ").when((first(t) == "'") | t.rlike(rf"\A(?:{_NUMBER})\z"), "?")
                       .when(first(t).isin('"', "`"), F.translate(t, _SIGNS, _MASKS)).otherwise(t))
    s = F.trim(F.regexp_replace(F.array_join(even, ""), " +", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"\( ", "("), r" \)", ")")
    s = F.regexp_replace(s, r"\(\?(?: ?, ?\?)+\)", "(?, ...)")
    s = F.regexp_replace(s, r"(\(\?(?:, \.\.\.)?\))(?: ?, ?\1)+", "$1, ...")
    return F.translate(s, _MASKS, _SIGNS)


def statement_digest(query_log: DataFrame, sort: str = "total", limit: int | None = None, min_ms: float = 0.0) -> DataFrame:
    """Slow-statement table from a query log with ``statement, duration_ms, error, rows, ts_ms``."""
    by = {"total": "total_ms", "avg": "avg_ms", "max": "max_ms", "calls": "calls"}
    if sort not in by:
        raise ValueError(f"sort must be one of {sorted(by)}, not {sort!r}")
    out = (query_log.where(F.col("duration_ms") >= min_ms)
           .groupBy(normalize_statement(F.col("statement")).alias("digest")).agg(
               F.min("statement").alias("sample"), F.count("*").alias("calls"),
               F.count_if("error").alias("errors"), F.avg("duration_ms").alias("avg_ms"),
               quantiles(F.col("duration_ms"), (0.95,))[0].alias("p95_ms"), F.max("duration_ms").alias("max_ms"),
               F.sum("duration_ms").alias("total_ms"), F.sum("rows").alias("rows"), F.max("ts_ms").alias("last_seen_ms")))
    return at_most(out.orderBy(F.desc(by[sort]), "digest"), limit)
