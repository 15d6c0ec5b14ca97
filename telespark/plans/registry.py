"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telespark.plans import sqlviews

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **consts):
    """Register a query.  Views that ``sql`` mentions are put in front of it as common
    table expressions; ``$NAME`` is replaced from ``consts``."""

    def add(fn: Runner) -> Runner:
        if name in QUERIES:
            raise KeyError(name)

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the derived tables read zone-less timestamps as UTC instants
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sqlviews.with_views(sqlviews.fill(sql, consts))
        return fn

    return add
