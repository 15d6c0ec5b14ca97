"""Limits that a caller may set; without one everything is returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.lineage import written

IN_MEMORY = 100_000     # rows that each task may hold to find the first ones of an order

def at_most(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)


def first_of(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows in the given order, in that order.

    Spark finds them in a heap of ``n`` rows in each task. More than a task may hold are sorted and written instead:
    a row's number tells its sorted range and its place in it, so the ranges' sizes tell which rows are within the first ``n``."""
    if n is None or n <= IN_MEMORY:
        return at_most(df.orderBy(*order), n)
    path = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    rows = df.sparkSession.read.parquet(path)
    sizes = rows.groupBy(F.shiftright("__at", 33).alias("range")).count().orderBy("range").collect()
    for r in sizes:
        if r["count"] >= n:
            rows = rows.where(F.col("__at") < (r["range"] << 33) + n)
            break
        n -= r["count"]
    return rows.orderBy("__at").drop("__at")


def at_most_per(df: DataFrame, keys: list[str], order: list, n: int | None) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    if n is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
