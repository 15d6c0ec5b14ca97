"""Rule-based cost allocation, prepaid amortisation, day matrices and comparisons."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.maths import change_pct, money_round
from telespark.functions.timeaxis import days_in_period, period_plus, periods_between, shift_period
from telespark.operators.bills import DIMENSIONS, BillFilter, BillSource, normalize_bill, service_months
from telespark.sources.schema import column_kind, missing_columns

MAX_RULES, MAX_LOOKBACK, DEFAULT_LOOKBACK = 200, 120, 36
MAX_WINDOW_DAYS = 366
AMORTIZE_FORWARD = 12
UNMATCHED = -1
PRODUCT_DAYS, MAX_PRODUCT_DAYS = 62, 92
# Comparison modes as (days per side, days back).
COMPARE_MODES = {"day": (1, 1), "week": (1, 7), "7d": (7, 7), "14d": (14, 14), "30d": (30, 30)}
TREND_DAYS = 14
DIM_NAMES = tuple(DIMENSIONS["alicloud"])


# --- configuration ---------------------------------------------------------------------

@dataclass(frozen=True)
class ColumnMatch:
    column: str
    op: str                      # any_of, like, not_like
    value: object


@dataclass(frozen=True)
class Matcher:
    """Conditions on a bill line, all of which must hold; none at all always holds."""

    provider: str | None = None
    dims: dict[str, tuple[str, ...]] = field(default_factory=dict)
    columns: tuple[ColumnMatch, ...] = ()

    @property
    def empty(self) -> bool:
        return self.provider is None and not self.dims and not self.columns

    def predicate(self, src: BillSource) -> Column:
        """A matcher for another provider or on a column the table lacks never holds."""
        if self.provider not in (None, src.provider) or missing_columns(src.df, [c.column for c in self.columns]):
            return F.lit(False)
        out = F.lit(True)
        for d, values in self.dims.items():
            out = out & src.dimension(d).isin(list(values))
        for c in self.columns:
            text = F.col(c.column)
            if column_kind(src.df.schema[c.column].dataType) != "string":
                text = text.cast("string")
            text = F.coalesce(text, F.lit(""))
            hit = {"any_of": lambda t, v: t.isin(list(v)), "like": lambda t, v: t.like(v), "not_like": lambda t, v: ~t.like(v)}
            out = out & hit[c.op](text, c.value)
        return out


@dataclass(frozen=True)
class Rule:
    name: str
    matcher: Matcher
    shares: tuple[tuple[int, float], ...]       # (line index, part of 1)


@dataclass(frozen=True)
class Alloc:
    lines: tuple[str, ...] = ()
    unmatched: int | None = None
    include: tuple[Matcher, ...] = ()
    rules: tuple[Rule, ...] = ()
    prepaid: Matcher | None = None
    lookback_months: int = DEFAULT_LOOKBACK


class AllocError(ValueError):
    """The allocation file is wrong; silently dropping a rule would misstate money."""


def _only(entry: dict, allowed, where: str) -> None:
    odd = set(entry) - set(allowed)
    if odd:
        raise AllocError(f"{where}: unknown key {', '.join(sorted(odd))}")


def _matcher(entry: dict, where: str) -> Matcher:
    provider = entry.get("provider")
    if provider is not None and provider not in DIMENSIONS:
        raise AllocError(f"{where}: provider must be one of {', '.join(DIMENSIONS)}")
    dims = {}
    for d in DIM_NAMES:
        if d in entry:
            if not isinstance(entry[d], list) or not entry[d]:
                raise AllocError(f"{where}: {d} needs a non-empty list")
            dims[d] = tuple(map(str, entry[d]))
    columns = []
    for c in entry.get("columns", []):
        _only(c, ("name", "any_of", "like", "not_like"), f"{where}: columns")
        ops = [o for o in ("any_of", "like", "not_like") if o in c]
        if not str(c.get("name", "")).strip() or len(ops) != 1:
            raise AllocError(f"{where}: a column condition needs a name and exactly one of any_of, like, not_like")
        if ops == ["any_of"] and not c["any_of"]:
            raise AllocError(f"{where}: any_of is empty")
        columns.append(ColumnMatch(c["name"], ops[0], tuple(c["any_of"]) if ops == ["any_of"] else c[ops[0]]))
    return Matcher(provider, dims, tuple(columns))


CONDITION_KEYS = ("name", "provider", "columns", *DIM_NAMES)


def allocation_config(source: str | dict) -> Alloc:
    """Validated allocation rules from TOML text or an equal dict."""
    try:
        data = tomllib.loads(source) if isinstance(source, str) else source
    except tomllib.TOMLDecodeError as e:
        raise AllocError(str(e)) from None
    _only(data, ("lines", "unmatched", "include", "rules", "prepaid"), "file")
    lines = data.get("lines") or []
    if not lines or any(not str(n).strip() for n in lines) or len(set(lines)) != len(lines):
        raise AllocError("lines: name at least one business line, without blanks or repeats")
    at = {n: i for i, n in enumerate(lines)}

    def line(name, where):
        if name not in at:
            raise AllocError(f"{where}: {name!r} is not in lines")
        return at[name]

    unmatched = line(data["unmatched"], "unmatched") if data.get("unmatched") is not None else None
    include = []
    for i, e in enumerate(data.get("include", []), 1):
        _only(e, CONDITION_KEYS, f"include {i}")
        include.append(_matcher(e, f"include {i}"))
    prepaid, lookback = None, DEFAULT_LOOKBACK
    if data.get("prepaid") is not None:
        e = data["prepaid"]
        _only(e, (*CONDITION_KEYS, "lookback_months"), "prepaid")
        lookback = e.get("lookback_months", DEFAULT_LOOKBACK)
        if not 1 <= lookback <= MAX_LOOKBACK:
            raise AllocError(f"prepaid: lookback_months must lie between 1 and {MAX_LOOKBACK}")
        prepaid = _matcher(e, "prepaid")
        if prepaid.empty:
            raise AllocError("prepaid: without a condition every line would be prepaid")
    rules = []
    if len(data.get("rules", [])) > MAX_RULES:
        raise AllocError(f"at most {MAX_RULES} rules")
    for i, e in enumerate(data.get("rules", []), 1):
        name = str(e.get("name") or "").strip() or f"rule {i}"
        where = f"rule {name!r}"
        _only(e, (*CONDITION_KEYS, "to", "split"), where)
        if ("to" in e) == ("split" in e):
            raise AllocError(f"{where}: give either to or split")
        split = {e["to"]: 1.0} if "to" in e else e["split"]
        if not split or any(not (isinstance(w, (int, float)) and math.isfinite(w) and w > 0) for w in split.values()):
            raise AllocError(f"{where}: weights must be positive")
        whole = float(sum(split.values()))
        shares = sorted((line(n, where), w / whole) for n, w in split.items())
        rules.append(Rule(name, _matcher(e, where), tuple(shares)))
    return Alloc(tuple(lines), unmatched, tuple(include), tuple(rules), prepaid, lookback)


# --- rules on lines ------------------------------------------------------------------------

def classify_rules(src: BillSource, alloc: Alloc) -> Column:
    """Index of the first matching rule, −1 for none; rules after it are not evaluated."""
    if not alloc.rules:
        return F.lit(UNMATCHED)
    hits = [F.when(r.matcher.predicate(src), i) for i, r in enumerate(alloc.rules)]
    return F.coalesce(*hits, F.lit(UNMATCHED))


def alloc_rows(src: BillSource, f: BillFilter, alloc: Alloc, window_days: int | None = None) -> BillSource:
    """The source narrowed to lines that take part: included, not amortised elsewhere,
    and within the last ``window_days`` billed days of this table."""
    df = src.df
    if alloc.include:
        keep = F.lit(False)
        for m in alloc.include:
            keep = keep | m.predicate(src)
        df = df.where(keep)
    if alloc.prepaid is not None and src.amortizable:
        df = df.where(~alloc.prepaid.predicate(src))
    if window_days is not None:
        if not 1 <= window_days <= MAX_WINDOW_DAYS:
            raise ValueError(f"days must lie between 1 and {MAX_WINDOW_DAYS}")
        if not src.has_days:
            raise ValueError("the monthly table has no days")
        last = src.df.where(src.in_periods(f.first, f.last)).agg(F.max(src.date())).scalar()
        df = df.where(src.date() >= F.date_sub(last, window_days - 1))
    return BillSource(src.kind, df, src.keys, src.mode)


def alloc_detail(sources: list[BillSource], f: BillFilter, alloc: Alloc, amount: str = "payable",
                 window_days: int | None = None) -> DataFrame:
    """Postpaid money by ``provider, rule, product, bucket, period``; ``bucket`` is the
    day, the period for monthly tables, or empty.  Everything else is regrouped from it,
    so ``materialize`` it when more than one table is wanted."""
    out = None
    for src in sources:
        part = alloc_rows(src, f, alloc, window_days)
        rows = normalize_bill(part, f, amount, {"rule": classify_rules(part, alloc)})
        bucket = F.col("day") if src.has_days else F.col("period")
        one = (rows.groupBy("provider", "rule", "product", bucket.alias("bucket"), "period")
                   .agg(F.sum("amount").alias("amount")).withColumn("has_days", F.lit(src.has_days)))
        out = one if out is None else out.unionByName(one)
    return out


def alloc_by_period(detail: DataFrame) -> DataFrame:
    return (detail.where("period <> ''").groupBy("provider", "rule", "period")
                  .agg(money_round(F.sum("amount").cast("double")).alias("amount")))


def prepaid_amortise(sources: list[BillSource], f: BillFilter, alloc: Alloc, amount: str = "payable") -> DataFrame | None:
    """Purchases spread over their service months: ``provider, rule, product, period,
    amount`` from the first period up to a year after the last.  Purchases are looked
    for ``lookback_months`` back; the service period itself is not cut."""
    if alloc.prepaid is None:
        return None
    back = replace(f, lookback=alloc.lookback_months)
    out = None
    for src in sources:
        if not src.amortizable:
            continue
        bought = BillSource(src.kind, src.df.where(alloc.prepaid.predicate(src)), src.keys, src.mode)
        extra = {"rule": classify_rules(bought, alloc),
                 "months": service_months(F.col("service_period"), F.col("service_period_unit"))}
        rows = normalize_bill(bought, back, amount, extra)
        one = rows.groupBy("provider", "rule", "product", "period", "months").agg(F.sum("amount").cast("double").alias("amount"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    # only months that can be shown are made: a part's size follows the real period
    last = shift_period(f.last, AMORTIZE_FORWARD)
    reach = F.months_between(F.to_date(F.lit(last), "yyyy-MM"), F.to_date("period", "yyyy-MM")).cast("int")
    parts = out.withColumn("until", F.least(F.col("months") - 1, reach)).where("until >= 0").select(
        "provider", "rule", "product", "period", (F.col("amount") / F.col("months")).alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("until"))).alias("k"))
    shifted = parts.withColumn("period", period_plus(F.col("period"), F.col("k")))
    return (shifted.where(F.col("period").between(f.first, last))
                   .groupBy("provider", "rule", "product", "period").agg(F.sum("part").alias("amount")))


def prepaid_sources(sources: list[BillSource], monthly: BillSource | None) -> list[BillSource]:
    """Amortisation reads the monthly grain where there is one: its history is longest."""
    return [monthly if s.kind == "alicloud_daily" and monthly is not None else s for s in sources]


# --- spreading ----------------------------------------------------------------------------

def spread(rows: DataFrame, alloc: Alloc, measures=("amount",)) -> DataFrame:
    """Send each row's measures to business lines by its rule's shares.

    Adds ``line`` (NULL where nothing takes unmatched money) and ``rule_name``.  The
    shares are configuration and travel as a constant map."""
    def share(i, part):
        return F.struct(F.lit(alloc.lines[i] if i is not None else None).cast("string").alias("line"), F.lit(float(part)).alias("part"))

    table = F.create_map(*[x for i, r in enumerate(alloc.rules) for x in (
        F.lit(i), F.array(*[share(ln, w) for ln, w in r.shares]))],
        F.lit(UNMATCHED), F.array(share(alloc.unmatched, 1.0)))
    names = F.create_map(*[x for i, r in enumerate(alloc.rules) for x in (F.lit(i), F.lit(r.name))], F.lit(UNMATCHED), F.lit(None).cast("string"))
    out = rows.withColumn("rule_name", names[F.col("rule")]).select("*", F.inline(table[F.col("rule")]))
    return out.withColumns({m: F.col(m).cast("double") * F.col("part") for m in measures}).drop("part")


def provider_days(detail: DataFrame) -> DataFrame:
    """Billed days per provider (0 for tables without days)."""
    return detail.groupBy("provider").agg(
        F.count_distinct(F.when(F.col("has_days") & (F.col("bucket") != ""), F.col("bucket"))).alias("days"),
        F.min("has_days").alias("has_days"))


def with_daily(detail: DataFrame) -> DataFrame:
    """Add ``daily``: each amount over its own provider's billed days; NULL everywhere
    as soon as one source has no days.  The day counts are one row per provider."""
    days = provider_days(detail).select("provider", "days", F.min("has_days").over(Window.partitionBy()).alias("complete"))
    per_day = F.when(F.col("days") > 0, F.col("amount").cast("double") / F.col("days")).otherwise(0.0)
    return (detail.join(F.broadcast(days), "provider").withColumn("daily", F.when(F.col("complete"), per_day)).drop("days", "complete"))


def window_scale(f: BillFilter, window_days: int | None) -> float:
    """Part of the amortised money that belongs to the last N days."""
    if window_days is None:
        return 1.0
    first, after = (date.fromisoformat(p + "-01") for p in (f.first, shift_period(f.last, 1)))
    return min(1.0, window_days / (after - first).days)


def _both(detail: DataFrame, amortised: DataFrame | None, f: BillFilter, scale: float) -> DataFrame:
    """Postpaid and amortised money of the range as one row set."""
    post = with_daily(detail).select("provider", "rule", "product", F.col("amount").cast("double").alias("amount"), "daily",
                                     F.lit(False).alias("prepaid"))
    if amortised is None:
        return post
    pre = amortised.where(F.col("period") <= f.last).select(
        "provider", "rule", "product", (F.col("amount") * scale).alias("amount"), F.lit(None).cast("double").alias("daily"),
        F.lit(True).alias("prepaid"))
    return post.unionByName(pre)


def _share(total: Column) -> Column:
    return F.when(total > 0, F.col("amount") / total).otherwise(0.0)


def allocate_costs(detail: DataFrame, amortised: DataFrame | None, f: BillFilter, alloc: Alloc, window_days: int | None = None) -> DataFrame:
    """One row per business line: amount, its postpaid and amortised parts, daily, share."""
    money = _both(detail, amortised, f, window_scale(f, window_days))
    total = F.sum("amount").over(Window.partitionBy())          # over one row per line
    per = spread(money, alloc, ("amount", "daily")).groupBy("line").agg(
        F.sum("amount").alias("amount"), F.coalesce(F.sum(F.when(~F.col("prepaid"), F.col("amount"))), F.lit(0.0)).alias("postpaid"),
        F.coalesce(F.sum(F.when(F.col("prepaid"), F.col("amount"))), F.lit(0.0)).alias("amortized"), F.sum("daily").alias("daily"))
    out = per.withColumn("share", _share(total))
    return out.select("line", *[money_round(F.col(c)).alias(c) for c in ("amount", "postpaid", "amortized", "daily")], "share")


def alloc_items(detail: DataFrame, amortised: DataFrame | None, f: BillFilter, alloc: Alloc, window_days: int | None = None) -> DataFrame:
    """What each line consists of: ``line, product, rule_name, prepaid, amount, daily, share``."""
    money = _both(detail, amortised, f, window_scale(f, window_days))
    total = money.agg(F.sum("amount")).scalar()
    per = spread(money, alloc, ("amount", "daily")).groupBy("line", "product", "rule_name", "prepaid").agg(
        F.sum("amount").alias("amount"), F.sum("daily").alias("daily"))
    return per.select("line", "product", "rule_name", "prepaid", money_round(F.col("amount")).alias("amount"),
                      money_round(F.col("daily")).alias("daily"), _share(total).alias("share"))


def alloc_products(detail: DataFrame, amortised: DataFrame | None, f: BillFilter, window_days: int | None = None) -> DataFrame:
    """The same money by product only, and how much of it no rule matched."""
    money = _both(detail, amortised, f, window_scale(f, window_days))
    return money.groupBy("product", "prepaid").agg(
        money_round(F.sum("amount")).alias("amount"), money_round(F.sum("daily")).alias("daily"),
        money_round(F.coalesce(F.sum(F.when(F.col("rule") == UNMATCHED, F.col("amount"))), F.lit(0.0))).alias("unmatched"))


def alloc_points(detail: DataFrame, alloc: Alloc) -> DataFrame:
    """Money per bucket and line over time."""
    rows = spread(detail.where("bucket <> ''"), alloc)
    return rows.groupBy("bucket", "line").agg(money_round(F.sum("amount")).alias("amount"))


def daily_average(detail: DataFrame) -> DataFrame:
    """Σ over providers of money per that provider's own billed days."""
    return with_daily(detail).agg(money_round(F.sum("daily")).alias("daily"))


def alloc_monthly(detail: DataFrame, amortised: DataFrame | None, f: BillFilter, alloc: Alloc) -> DataFrame:
    """``provider, kind, line, period, amount`` of whole months."""
    rows = detail.where("period <> ''").select("provider", "rule", "period", F.col("amount").cast("double").alias("amount"),
                                               F.lit("postpaid").alias("kind"))
    if amortised is not None:
        rows = rows.unionByName(amortised.where(F.col("period") <= f.last).select(
            "provider", "rule", "period", "amount", F.lit("prepaid").alias("kind")))
    per = rows.groupBy("provider", "kind", "rule", "period").agg(F.sum("amount").alias("amount"))
    return spread(per, alloc).groupBy("provider", "kind", "line", "period").agg(F.sum("amount").alias("amount"))


def amortised_by_period(amortised: DataFrame, alloc: Alloc) -> DataFrame:
    """Amortised money per line and period, future ones included."""
    return spread(amortised, alloc).groupBy("line", "period").agg(F.sum("amount").alias("amount"))


def monthly_estimate(lines: DataFrame, amortised: DataFrame | None, alloc: Alloc, target: str) -> DataFrame:
    """Projection for one period: daily × its days + what is amortised into it; NULL
    without a daily figure."""
    days = days_in_period(F.lit(target))
    if amortised is None:
        return lines.withColumn("estimate", F.round(F.col("daily") * days, 2))
    into = amortised_by_period(amortised.where(F.col("period") == target), alloc).select(
        F.col("line").alias("__line"), F.col("amount").alias("__into"))
    out = lines.join(into, F.col("line").eqNullSafe(F.col("__line")), "left")
    return (out.withColumn("estimate", F.round(F.col("daily") * days + F.coalesce("__into", F.lit(0.0)), 2))
               .drop("__line", "__into"))


def alloc_section(monthly: DataFrame, f: BillFilter, provider: str | None = None, kind: str | None = None) -> DataFrame:
    """Line × month matrix of one cloud and payment kind (or all), with subtotal and share."""
    rows = monthly
    if provider is not None:
        rows = rows.where(F.col("provider") == provider)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    periods = periods_between(f.first, f.last)
    wide = rows.groupBy("line").pivot("period", periods).agg(F.sum("amount"))
    wide = wide.select("line", *[F.coalesce(F.col(f"`{p}`"), F.lit(0.0)).alias(p) for p in periods])
    subtotal = sum((F.col(f"`{p}`") for p in periods), F.lit(0.0))
    total = rows.where(F.col("period").isin(periods)).agg(F.sum("amount")).scalar()
    return (wide.withColumn("subtotal", subtotal)
                .withColumn("share", F.when(total != 0, F.col("subtotal") / total)))


def alloc_summary(monthly: DataFrame) -> DataFrame:
    """Payment kinds, a subtotal per cloud and the grand total, per period."""
    r = monthly.groupBy("period", "provider", "kind").agg(F.sum("amount").alias("amount"))
    out = r.groupingSets([[F.col("period"), F.col("provider"), F.col("kind")], [F.col("period"), F.col("provider")], [F.col("period")]],
                         F.col("period"), F.col("provider"), F.col("kind")).agg(
        (F.grouping("provider") + F.grouping("kind")).cast("int").alias("level"), F.sum("amount").alias("amount"))
    tone = F.when(F.col("level") == 0, "plain").when(F.col("level") == 1, "sub").otherwise("total")
    return out.select("period", "provider", "kind", tone.alias("tone"), money_round(F.col("amount")).alias("amount"))


# --- days -----------------------------------------------------------------------------------

def allocation_day(sources: list[BillSource], day: str, alloc: Alloc, base: BillFilter | None = None, amount: str = "payable") -> DataFrame:
    """One day against the day before, by line, provider, product and rule."""
    d = date.fromisoformat(day)
    before = d - timedelta(days=1)
    base = base or BillFilter(day[:7], day[:7])
    f = BillFilter(before.isoformat()[:7], day[:7], base.dims, base.q, (before.isoformat(), day))
    detail = alloc_detail([s for s in sources if s.has_days], f, alloc, amount)
    side = lambda at: F.sum(F.when(F.col("bucket") == at, F.col("amount")).otherwise(0.0))
    per = spread(detail, alloc).groupBy("line", "provider", "product", "rule_name").agg(
        side(day).alias("current"), side(before.isoformat()).alias("previous"))
    out = per.select("line", "provider", "product", "rule_name", money_round(F.col("current")).alias("current"),
                     money_round(F.col("previous")).alias("previous"))
    return out.where("current <> 0 or previous <> 0")


def product_days(sources: list[BillSource], today: date, alloc: Alloc = Alloc(), base: BillFilter | None = None,
                 days: int = PRODUCT_DAYS, amount: str = "payable") -> DataFrame:
    """Postpaid money by ``provider, product, day`` of the ``days`` days up to today.
    Lines without a day or dated after today fall out."""
    if not 2 <= days <= MAX_PRODUCT_DAYS:
        raise ValueError(f"days must lie between 2 and {MAX_PRODUCT_DAYS}")
    since = today - timedelta(days=days - 1)
    f = BillFilter(since.isoformat()[:7], today.isoformat()[:7], base.dims if base else {}, base.q if base else "",
                   (since.isoformat(), today.isoformat()))
    detail = alloc_detail([s for s in sources if s.has_days], f, alloc, amount)
    return (detail.where("bucket <> ''").groupBy("provider", "product", F.col("bucket").alias("day"))
                  .agg(money_round(F.sum("amount").cast("double")).alias("amount")))


def product_matrix(pd: DataFrame, today: date, days: int = PRODUCT_DAYS) -> DataFrame:
    """One row per provider and product with its amounts day by day; all-zero rows left out."""
    axis = F.array(*[F.lit((today - timedelta(days=days - 1 - i)).isoformat()) for i in range(days)])
    per = pd.groupBy("provider", "product").agg(F.map_from_entries(F.collect_list(F.struct("day", "amount"))).alias("m"))
    out = per.select("provider", "product", F.transform(axis, lambda d: F.coalesce(F.col("m")[d], F.lit(0.0))).alias("amounts"))
    return out.where(F.exists("amounts", lambda v: v != 0))


def last_billed_day(pd: DataFrame) -> DataFrame:
    return pd.groupBy("provider").agg(F.max("day").alias("last_day"))


def monthly_only(everything: list[BillSource]) -> list[str]:
    """Providers that can only be read by month."""
    daily = {s.provider for s in everything if s.has_days}
    return sorted({s.provider for s in everything} - daily)


def _billed_days(pd: DataFrame) -> DataFrame:
    """All (day, provider) totals as one row: at most 92 days times the providers."""
    cells = pd.groupBy("day", "provider").agg(F.sum("amount").alias("t"))
    return cells.agg(F.collect_list(F.struct("day", "provider", "t")).alias("cells"))


def _end_of(cells: Column, today: date, mode: str) -> Column:
    """Last day that every cloud has billed, today excluded; where that lies too far back
    for the comparison, the last day any cloud has."""
    width, back = COMPARE_MODES[mode]
    providers = F.array_distinct(F.transform(cells, lambda c: c["provider"]))
    lasts = F.transform(providers, lambda p: F.array_max(F.transform(F.filter(cells, lambda c: c["provider"] == p), lambda c: c["day"])))
    yesterday = F.lit((today - timedelta(days=1)).isoformat())
    aligned, newest = F.least(F.array_min(lasts), yesterday), F.least(F.array_max(lasts), yesterday)
    reach = F.date_diff(F.lit(today), F.to_date(aligned)) + back + width
    return F.when(reach <= MAX_PRODUCT_DAYS, aligned).otherwise(newest)


def default_end(pd: DataFrame, today: date, mode: str) -> DataFrame:
    """The end day ``cost_compare`` uses when none is given, as one row ``end``."""
    return _billed_days(pd).select(_end_of(F.col("cells"), today, mode).alias("end"))


def cost_compare(pd: DataFrame, today: date, mode: str = "day", end: str | None = None) -> DataFrame:
    """Two equally long spans of days by product.  When the spans have different numbers
    of billed days the figures become per-day; ``pending`` marks clouds not billed up to
    the end.  Largest change first.

    What the spans look like is one small struct, computed once and used as a scalar."""
    if mode not in COMPARE_MODES:
        raise ValueError(f"mode must be one of {', '.join(COMPARE_MODES)}, not {mode!r}")
    width, back = COMPARE_MODES[mode]
    cells = F.col("cells")
    at = F.lit(end) if end is not None else _end_of(cells, today, mode)

    def billed(first: int) -> Column:
        days = F.array_distinct(F.transform(cells, lambda c: c["day"]))
        inside = F.filter(days, lambda d: F.date_diff(F.to_date("end"), F.to_date(d)).between(first, first + width - 1))
        total = lambda d: F.aggregate(F.filter(cells, lambda c: c["day"] == d), F.lit(0.0), lambda a, c: a + c["t"])
        return F.size(F.filter(inside, lambda d: total(d) != 0))

    shape = (_billed_days(pd).withColumn("end", at)
             .select(F.struct("end", billed(0).alias("c"), billed(back).alias("p")).alias("s")))
    placed = pd.withColumn("s", shape.scalar())
    ago = F.date_diff(F.to_date("s.end"), F.to_date("day"))
    # the spans are the same for every row, so they are part of the grouping key
    per = placed.withColumn("ago", ago).groupBy("provider", "product", "s").agg(
        F.coalesce(F.sum(F.when(F.col("ago").between(0, width - 1), F.col("amount"))), F.lit(0.0)).alias("cur"),
        F.coalesce(F.sum(F.when(F.col("ago").between(back, back + width - 1), F.col("amount"))), F.lit(0.0)).alias("prev"),
        F.max("day").alias("last"))
    last = F.max("last").over(Window.partitionBy("provider"))       # over one row per product
    c, p = F.col("s.c"), F.col("s.p")
    daily = F.lit(width > 1) & (c > 0) & (p > 0) & (c != p)
    sums = per.withColumns({"basis": F.when(daily, "daily").otherwise("total"), "pending": last < F.col("s.end")})
    sums = sums.withColumns({"cur": F.when(F.col("basis") == "daily", F.col("cur") / c).otherwise(F.col("cur")),
                             "prev": F.when(F.col("basis") == "daily", F.col("prev") / p).otherwise(F.col("prev"))})
    return sums.where("cur <> 0 or prev <> 0").select(
        "provider", "product", F.round("cur", 2).alias("current"), F.round("prev", 2).alias("previous"),
        F.round(F.col("cur") - F.col("prev"), 2).alias("delta"), change_pct(F.col("cur"), F.col("prev")).alias("change_pct"),
        "basis", F.col("s.end").alias("end"), "pending").orderBy(F.desc(F.abs("delta")), "provider", "product")


def product_trend(pd: DataFrame, mode: str, end: str) -> DataFrame:
    """Day-by-day course of every product.  Spans are laid over each other day by day;
    single-day modes show the last two weeks with the two compared days marked."""
    width, back = COMPARE_MODES[mode]
    last = date.fromisoformat(end)
    n = TREND_DAYS if width == 1 else width
    days = [(last - timedelta(days=n - 1 - i)) for i in range(n)]
    axis = F.array(*[F.struct(F.lit(d.isoformat()).alias("day"), F.lit((d - timedelta(days=back)).isoformat()).alias("previous_day"),
                              F.lit(d == last or (last - d).days == back).alias("mark")) for d in days])
    m = pd.groupBy("provider", "product").agg(F.map_from_entries(F.collect_list(F.struct("day", "amount"))).alias("m"))
    rows = m.select("provider", "product", "m", F.inline(axis))
    value = F.coalesce(F.col("m")[F.col("day")], F.lit(0.0))
    before = F.coalesce(F.col("m")[F.col("previous_day")], F.lit(0.0))
    if width == 1:
        return rows.select("provider", "product", "day", value.alias("value"), "mark")
    return rows.select("provider", "product", "day", value.alias("value"), "previous_day", before.alias("previous"))
