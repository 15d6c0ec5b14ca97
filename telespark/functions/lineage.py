"""Cutting lineage of iterative plans in a way that survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}       # application -> folder made for it


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of its own is made, once for each
    application, on a single local machine only, as executors elsewhere could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not re.match(r"local($|\[)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="telespark-checkpoint-")
        forget_at_exit(spark, _OWN[sc.applicationId])
    return _OWN[sc.applicationId]


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have an existing file or folder deleted when the application's JVM ends."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
        forget_at_exit(spark, sc.getCheckpointDir())


def written(df: DataFrame, name: str) -> str:
    """Path of ``df`` as a new Parquet table in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and read back from shared storage: for small aggregates that
    several results are regrouped from."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()
