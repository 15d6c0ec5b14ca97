import pytest
from pyspark.sql import functions as F

from telespark.functions.timeaxis import (DAY, HOUR, LADDER, MINUTE, Bucket, TimeRange, compare_shift, days_in_period, local_midnight,
                                          period_plus, periods_between, shift_period)

NOW = 1_788_857_535_000      # 2026-09-08 16:52:15 in Shanghai


def test_range_defaults_and_limits():
    r = TimeRange.resolve(now_ms=NOW)
    assert (r.from_ms, r.to_ms) == (NOW - HOUR, NOW)
    for bad in (dict(from_ms=NOW, to_ms=NOW), dict(from_ms=NOW - 32 * DAY, to_ms=NOW), dict(from_ms=-1, to_ms=NOW)):
        with pytest.raises(ValueError):
            TimeRange.resolve(**bad)
    assert r.widen(60_000) == TimeRange(NOW - HOUR - 60_000, NOW + 60_000)
    assert TimeRange(10, 20).widen(60).from_ms == 0


def test_buckets_start_at_local_midnight():
    start = 1_788_800_400_000            # 01:00 in Shanghai
    r = TimeRange(start, start + 6 * HOUR)
    b = Bucket.choose(r, "Asia/Shanghai", 120)
    assert (b.width_ms, b.origin_ms, b.count(r)) == (5 * MINUTE, 1_788_796_800_000, 72)
    assert b.origin_ms + b.first(r) * b.width_ms == start
    assert Bucket.choose(TimeRange(start, start + 30 * DAY), "Asia/Shanghai", 120).width_ms == 6 * HOUR


@pytest.mark.parametrize("span", [1, 1000, 90_000, HOUR, 25 * HOUR, 31 * DAY])
def test_bucket_count_is_bounded(span):
    r = TimeRange(NOW - span, NOW)
    b = Bucket.choose(r, "Asia/Shanghai", 120)
    assert b.width_ms in LADDER and b.count(r) <= 121


def test_too_fine_a_step():
    with pytest.raises(ValueError):
        Bucket.of_width(TimeRange(0, DAY), 1000)


def test_midnight_skipped_by_clock_change():
    noon = 1_538_928_000_000 + 28 * DAY      # 2018-11-04 in Sao Paulo: the day starts at 01:00
    assert local_midnight(noon, "America/Sao_Paulo") == 1_541_300_400_000


def test_bucket_index_floors(spark):
    b = Bucket(1000, 10_000)
    df = spark.createDataFrame([(9_999,), (10_000,), (10_999,), (12_000,)], "ms long").select(F.timestamp_millis("ms").alias("timestamp"))
    assert [r[0] for r in df.select(b.index()).collect()] == [-1, 0, 0, 2]


def test_last_partial_bucket_is_dropped():
    r = TimeRange(0, 2_500)
    assert Bucket(1000, 0).complete(r) == 2 and Bucket(1000, 0).complete(TimeRange(0, 3000)) == 3


def test_compare():
    r = TimeRange(DAY, DAY + HOUR)
    assert [compare_shift(k, r) for k in ("prev", "day", "week", "none")] == [HOUR, DAY, 7 * DAY, None]
    with pytest.raises(ValueError):
        compare_shift("month", r)


def test_periods(spark):
    assert periods_between("2025-11", "2026-02") == ["2025-11", "2025-12", "2026-01", "2026-02"]
    assert shift_period("2026-01", -1) == "2025-12" and shift_period("2025-12", 14) == "2027-02"
    for a, b in (("2026-02", "2026-01"), ("2020-01", "2026-01"), ("2026-13", "2026-13"), ("26-1", "26-1")):
        with pytest.raises(ValueError):
            periods_between(a, b)
    row = spark.range(1).select(days_in_period(F.lit("2024-02")), period_plus(F.lit("2025-12"), F.lit(13))).head()
    assert tuple(row) == (29, "2027-01")
