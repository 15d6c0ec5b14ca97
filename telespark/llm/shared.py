"""What the operators share: the cluster's shared folder, written tables, range buckets, text keys."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.functions.lineage import forget_at_exit, shared_folder

_SHIPPED: set[str] = set()
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    """What an operator keeps in a Python worker between tasks. Workers serve one operator after the other:
    only the last one's is held."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go of what earlier tasks of other operators left in this Python worker."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: where they would not find it by PYTHONPATH or the
    working folder, it is sent to them as a zip, once for each Spark application."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in map(os.path.realpath, [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]):
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    path = Path(tempfile.mkdtemp(prefix="telespark-code-"), "telespark.zip")        # Spark's file server reads it from here
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(Path(root, "telespark").rglob("*.py")):
            out.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts the lineage and outlives lost executors.
    The table goes when the application ends."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, most: int):
    """Arrow batches of at most ``most`` rows in what is computed meanwhile: for rows of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending split points of a numeric column, from one approximate-quantile sketch."""
    if n < 2:
        return []
    cuts = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 20 * n)).first()[0]
    return sorted(set(cuts or []))


def range_bucket(column: str, bounds: list[int]) -> Column:
    """Number of bounds below the value (nulls: 0): a binary search whose steps are unrolled by ``aggregate``."""
    if not bounds:
        return F.lit(0)
    n, step, steps = len(bounds), 1, [1]
    while step * 2 <= n:
        step *= 2
        steps.insert(0, step)
    below = F.array(*map(F.lit, bounds))

    def move(at: Column, by: Column) -> Column:
        return F.when((at + by <= n) & (F.get(below, at + by - 1) < F.col(column)), at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), move)


def slices(texts: list[str], most: int = 1 << 21):
    """Index ranges of consecutive texts with about ``most`` characters each (a longer text stands alone)."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
