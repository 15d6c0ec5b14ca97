"""Time ranges, buckets and comparison windows.

Ranges are half-open ``[from_ms, to_ms)`` in unix milliseconds.  Everything here
is driver-side arithmetic that ends up as literals in the plan, so bounds reach
the scan as constant predicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000

# The bucket widths a chart may use, in milliseconds.
LADDER = (
    1_000, 2_000, 5_000, 10_000, 15_000, 30_000,
    60_000, 120_000, 300_000, 600_000, 900_000, 1_800_000,
    3_600_000, 7_200_000, 10_800_000, 21_600_000, 43_200_000,
    86_400_000, 172_800_000, 604_800_000,
)
DEFAULT_SPAN_MS = HOUR
MAX_SPAN_MS = 31 * DAY
LOG_BUCKETS = SPAN_BUCKETS = 120
SPARK_BUCKETS = 30
METRIC_BUCKETS = 60
METRIC_POINTS_LIMIT = 1000


@dataclass(frozen=True)
class TimeRange:
    from_ms: int
    to_ms: int

    @classmethod
    def resolve(cls, from_ms=None, to_ms=None, now_ms=None, max_span_ms=MAX_SPAN_MS) -> "TimeRange":
        """Fill in defaults (one hour up to now) and reject unusable ranges."""
        if to_ms is None:
            to_ms = now_ms
        if to_ms is None:
            raise ValueError("to_ms or now_ms is required")
        if from_ms is None:
            from_ms = to_ms - DEFAULT_SPAN_MS
        if min(from_ms, to_ms) < 0:
            raise ValueError("times are unix milliseconds and cannot be negative")
        if from_ms >= to_ms:
            raise ValueError("the range must start before it ends")
        if to_ms - from_ms > max_span_ms:
            raise ValueError(f"the range may span at most {max_span_ms} ms")
        return cls(from_ms, to_ms)

    @property
    def span_ms(self) -> int:
        return self.to_ms - self.from_ms

    def widen(self, ms: int) -> "TimeRange":
        return TimeRange(max(0, self.from_ms - ms), self.to_ms + ms)

    def shift(self, ms: int) -> "TimeRange":
        return TimeRange(max(0, self.from_ms + ms), max(1, self.to_ms + ms))

    def holds(self, column: str = "timestamp") -> Column:
        """Predicate on a TIMESTAMP column with literal bounds, so that partition
        pruning and row-group statistics apply."""
        c = F.col(column)
        return (c >= instant(self.from_ms)) & (c < instant(self.to_ms))


def instant(ms: int) -> Column:
    return F.lit(datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=ms))


def millis(column: str = "timestamp") -> Column:
    return F.unix_millis(F.col(column))


def local_midnight(ms: int, tz: str) -> int:
    """Unix ms of the local midnight before ``ms``; where a clock change skips
    midnight, the first instant of that day."""
    zone = ZoneInfo(tz)
    day = datetime.fromtimestamp(ms / 1000, zone).date()
    return int(datetime(day.year, day.month, day.day, tzinfo=zone).timestamp() * 1000)


@dataclass(frozen=True)
class Bucket:
    width_ms: int
    origin_ms: int

    @classmethod
    def choose(cls, rng: TimeRange, tz: str = "UTC", max_buckets: int = 120) -> "Bucket":
        fitting = [w for w in LADDER if max(1, rng.span_ms) // w <= max_buckets]
        return cls(fitting[0] if fitting else LADDER[-1], local_midnight(rng.from_ms, tz))

    @classmethod
    def of_width(cls, rng: TimeRange, width_ms: int, tz: str = "UTC",
                 max_points: int = METRIC_POINTS_LIMIT) -> "Bucket":
        b = cls(max(1, width_ms), local_midnight(rng.from_ms, tz))
        if b.count(rng) > max_points:
            raise ValueError(f"{b.count(rng)} points exceed the limit of {max_points}; use a wider step")
        return b

    def index(self, column: str = "timestamp") -> Column:
        """Bucket number of a TIMESTAMP column, floored (also before the origin)."""
        return F.floor((millis(column) - F.lit(self.origin_ms)) / F.lit(self.width_ms))

    def start(self, index: Column) -> Column:
        return F.lit(self.origin_ms) + index * F.lit(self.width_ms)

    def first(self, rng: TimeRange) -> int:
        return (rng.from_ms - self.origin_ms) // self.width_ms

    def last(self, rng: TimeRange) -> int:
        return (rng.to_ms - 1 - self.origin_ms) // self.width_ms

    def count(self, rng: TimeRange) -> int:
        return self.last(rng) - self.first(rng) + 1

    def complete(self, rng: TimeRange) -> int:
        """Number of buckets once a last bucket reaching past the range is dropped."""
        n = self.count(rng)
        reaches_past = self.origin_ms + (self.last(rng) + 1) * self.width_ms > rng.to_ms
        return n - 1 if n > 1 and reaches_past else n

    def shifted(self, ms: int) -> "Bucket":
        return Bucket(self.width_ms, self.origin_ms + ms)

    def every(self, rng: TimeRange) -> Column:
        """Array of all bucket numbers of the range (bounded by the ladder)."""
        return F.sequence(F.lit(self.first(rng)).cast("bigint"), F.lit(self.last(rng)).cast("bigint"))


def dense(bucket: Bucket, rng: TimeRange, values: DataFrame, keys: DataFrame | None = None, zero=()) -> DataFrame:
    """Every (bucket, key) cell: ``zero`` columns become 0 where nothing was seen, others
    stay NULL.  Each key row is unfolded into its buckets, so there is no cross join."""
    if keys is None:
        keys = values.sparkSession.range(1).select()
    grid = keys.select("*", F.explode(bucket.every(rng)).alias("bucket"))
    out = grid.join(values, ["bucket", *keys.columns], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}) if zero else out


def compare_shift(kind: str, rng: TimeRange) -> int | None:
    """How far back the comparison window lies; None for ``none``."""
    shifts = {"prev": rng.span_ms, "day": DAY, "week": 7 * DAY, "none": None}
    if kind not in shifts:
        raise ValueError(f"compare must be one of {sorted(shifts)}, not {kind!r}")
    return shifts[kind]


# --- bill periods ---------------------------------------------------------

def shift_period(period: str, months: int) -> str:
    y, m = map(int, period.split("-"))
    n = y * 12 + (m - 1) + months
    return f"{n // 12:04d}-{n % 12 + 1:02d}"


def check_period(period: str) -> str:
    try:
        datetime.strptime(period, "%Y-%m")
    except ValueError:
        raise ValueError(f"a period is YYYY-MM, not {period!r}") from None
    return period


def periods_between(first: str, last: str, limit: int = 36) -> list[str]:
    check_period(first), check_period(last)
    if first > last:
        raise ValueError("the first period must not be after the last")
    out = []
    while first <= last:
        out.append(first)
        first = shift_period(first, 1)
    if len(out) > limit:
        raise ValueError(f"at most {limit} periods")
    return out


def days_in_period(period: Column) -> Column:
    return F.dayofmonth(F.last_day(F.to_date(F.concat(period, F.lit("-01")))))


def period_plus(period: Column, months: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(period, F.lit("-01"))), months.cast("int")), "yyyy-MM")
