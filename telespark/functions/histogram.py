"""Arithmetic on explicit-bucket histograms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def diff_counts(cur: Column, prev: Column) -> Column:
    """Per-bucket growth of cumulative counts.  A bucket that fell was reset and counts
    whole; without a comparable predecessor the growth is zero everywhere."""
    grown = F.zip_with(cur, prev, lambda c, p: F.when(c >= p, c - p).otherwise(c))
    zero = F.transform(cur, lambda c: c - c)
    return F.when(F.size(prev) == F.size(cur), grown).otherwise(zero)


def quantile(counts: Column, bounds: Column, q: float) -> Column:
    """Linear interpolation inside the bucket that holds the ``q``-th observation.
    The open last bucket answers with the highest bound; an empty histogram with NULL."""
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"a quantile lies between 0 and 1, not {q}")
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    target = total * F.lit(float(q))
    # one pass: observations so far, and the first bucket that reaches the target with the observations up to it
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("upto"))

    def step(a: Column, c: Column) -> Column:
        now = a["sum"] + c
        hit = a["at"].isNull() & (now >= target)
        return F.struct((a["i"] + 1).alias("i"), now.alias("sum"), F.when(hit, a["i"]).otherwise(a["at"]).alias("at"), F.when(hit, now).otherwise(a["upto"]).alias("upto"))

    found = F.aggregate(counts, start, step)
    at = found["at"]
    here, upper, last = F.get(counts, at), F.get(bounds, at), F.element_at(bounds, -1)
    lower = F.when(at == 0, F.least(F.lit(0.0), upper)).otherwise(F.get(bounds, at - 1))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (target - (found["upto"] - here)) / F.nullif(here, F.lit(0))))
    inside = F.when(here <= 0, upper).otherwise(lower + (upper - lower) * part)
    return (F.when((total <= 0) | (F.size(bounds) <= 0), None)
             .when(at.isNull() | (at >= F.size(bounds)), last).otherwise(inside))


def quantile_label(q: float) -> str:
    p = q * 100
    return f"p{round(p)}" if abs(p - round(p)) < 1e-9 else f"p{p:g}"
