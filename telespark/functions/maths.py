"""Comparison arithmetic with its NULL and infinity conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILES = (0.5, 0.95, 0.99)
ACCURACY = 10_000


def change(cur: Column, prev: Column) -> Column:
    """cur/prev − 1; NULL without a previous value, 0 for 0→0, infinity for 0→n."""
    return (F.when(prev.isNull() | F.isnan(prev.cast("double")), None)
             .when(prev == 0, F.when(cur == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))))
             .otherwise(cur / prev - 1))


def change_pct(cur: Column, prev: Column) -> Column:
    return F.when(prev > 0, F.round((cur - prev) / prev * 100, 1))


def ratio(cur: Column, prev: Column) -> Column:
    return F.when(prev > 0, F.round(cur / prev, 2))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a rate, 0 when there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def quantiles(value: Column, qs=QUANTILES, accuracy: int = ACCURACY) -> Column:
    """Array of quantiles from a mergeable sketch of bounded size: exact ranks for
    small groups, rank error 1/accuracy for large ones."""
    return F.percentile_approx(value, list(qs), accuracy)


def ms(ns: Column) -> Column:
    return ns / 1_000_000


def money_round(x: Column) -> Column:
    """Four decimals, never −0."""
    return F.round(x, 4) + F.lit(0.0)


def head(text: Column, chars: int | None) -> Column:
    """The first characters of a text; all of it without a number."""
    return text if chars is None else F.substring(text, 1, chars)
