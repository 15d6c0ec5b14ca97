"""Connected components of an undirected graph given as (a, b) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component, for all nodes that have an edge.

    Alternates two steps until nothing changes, a number of rounds that grows with the logarithm of
    the longest path: each node's larger neighbours are tied to its smallest neighbour, then its
    smaller ones are. Every step keeps at most the number of edges, and every round is written out.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def large(df: DataFrame) -> DataFrame:
        both = df.union(df.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("least"))
        return pairs(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")))

    def small(df: DataFrame) -> DataFrame:
        least = df.groupBy("a").agg(F.min("b").alias("least"))
        tied = df.join(least, "a")
        return pairs(tied.select("b", F.col("least")).toDF("a", "b").union(least.select("a", F.col("least").alias("b"))))

    def mark(df: DataFrame):
        """Number of edges, and a sum over their hashes: equal for equal sets of edges."""
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    now, last = shared.written(pairs(edges), "edges"), None
    while True:
        now = shared.written(small(large(now)), "edges")
        new = mark(now)
        if new == last:         # each node is tied to the smallest of its component
            break
        last = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return shared.written(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
