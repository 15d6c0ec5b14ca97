"""Session settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cores: str = "*", partitions: int = 8, app: str = "telespark", **conf) -> SparkSession:
    """A local session for tests and the bench.  On a cluster use the session that
    is there; only ``spark.sql.session.timeZone=UTC`` matters for results."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(partitions))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "12g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # quantile sketches: keep hashing for a few thousand groups before sorting
         .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

