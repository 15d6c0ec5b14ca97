"""Operator 13: near-duplicate vectors of one label by collision counting over sorted projections.

Unit vectors are projected on ``LINES`` random directions. On each line the vectors are sorted, and two collide if one
lies in the window of half width w around the other. A pair at the least similarity is ``GAP`` = sqrt(2 - 2 LEAST) apart,
so it collides on a line with a known chance and the number of its collisions is binomial; nearer pairs collide more
often. The count that a pair must reach is calibrated so that a pair at the threshold misses it with chance ``MISS``.
Pairs that reach it are verified by their cosine in double precision.

Vectors are dealt out in an order that brings neighbours together (the sides of the first lines they lie on), and packed
into blocks of one label. Blocks meet in pairs, but only if windows of ``count`` lines at least can overlap,
which no pair that reaches the count fails. In a meeting the windows of one block's vectors are ranges of ranks among the other's.
From it go, for each vector, its number of links and one vector it is connected to, never the pairs.

Equal vectors of a label are one, with their number: copies are linked without being compared.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link
with nothing, nor do vectors of different lengths; every row is a vector of its own, also one repeated or without an id;
the component id is the smallest id in the component (null if it has none, and then no row of it is kept);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from telespark.llm import shared
from telespark.llm.components import components

LEAST = 0.93
LINES = 64
WIDTH = 1.5             # half width of a window, in distances of a pair at the threshold
MISS = 1e-9             # chance that a pair at the threshold does not reach the count
SIDES = 16              # lines whose sides order the vectors
BLOCK = 4096            # vectors of a block
TILE = 256              # of them counted at once against the other block
VERIFY = 1 << 15        # pairs verified at once
SLOT = 64               # summaries of blocks of a label that others are compared with in one task
SEED = 13


def window(least: float = LEAST) -> float:
    return WIDTH * sqrt(max(2 - 2 * least, 1e-12))


def calibrated(lines: int = LINES, width: float = WIDTH, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold fails with a chance of at most ``miss``."""
    p, below = erf(width / sqrt(2)), 0.0
    for count in range(lines + 1):
        below += comb(lines, count) * p ** count * (1 - p) ** (lines - count)
        if below > miss:
            return count
    return lines


def directions(dims: int) -> np.ndarray:
    """Random directions as columns: the projection of a difference of length d is normal with standard deviation d."""
    return np.random.Generator(np.random.PCG64(SEED)).standard_normal((dims, LINES))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, initial=0.0, keepdims=True)      # so squares neither overflow nor vanish
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, count: int, width: float, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) of pairs of unit vectors that reach ``count`` collisions and the cosine ``least``."""
    lines = directions(a.shape[1])
    of_a, of_b = a @ lines, b @ lines
    order = np.argsort(of_b, axis=0, kind="stable")
    rank = np.empty(of_b.shape, dtype=np.uint16)
    np.put_along_axis(rank, order, np.arange(len(b), dtype=np.uint16)[:, None], axis=0)
    ordered, rank = np.take_along_axis(of_b, order, axis=0).T, np.ascontiguousarray(rank.T)
    first = np.stack([np.searchsorted(ordered[k], of_a[:, k] - width, side="left") for k in range(LINES)]).astype(np.uint16)
    until = np.stack([np.searchsorted(ordered[k], of_a[:, k] + width, side="right") for k in range(LINES)]).astype(np.uint16)
    for low in range(0, len(a), TILE):
        high = min(low + TILE, len(a))
        seen = np.zeros((high - low, len(b)), dtype=np.uint8)
        for k in range(LINES):
            inside = until[k, low:high, None] - first[k, low:high, None]
            seen += (rank[k][None, :] - first[k, low:high, None]) < inside          # ranks before the window wrap round
        i, j = np.nonzero(seen >= count)
        for at in range(0, len(i), VERIFY):
            x, y = i[at:at + VERIFY] + low, j[at:at + VERIFY]
            near = np.einsum("ij,ij->i", a[x], b[y]) >= least
            yield x[near], y[near]


class Union:
    """Which of n places are connected."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[k] with b[k] for all k: roots are tied to smaller ones until none differ."""
        while len(a):
            a, b = self.find(a), self.find(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            a, b = low[apart], high[apart]
            np.minimum.at(self.root, b, a)

    def find(self, a: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[a]
            if (up == a).all():
                return a
            self.root[a] = self.root[up]
            a = up


# ------------------------------------------------------------------------------------------- Spark side

def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector): every row; ``vector`` is null where it links with nothing."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    vector = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda c: c != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(good, vector).alias("vector"))


def _nodes(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector, node): rows that can link, with the digest of their label and vector."""
    size = 4 if rows.schema["vector"].dataType.elementType.simpleString() == "float" else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, column = batch.column(1).to_pylist(), batch.column(2)
            data = memoryview(np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False) + 0)).cast("B")      # -0.0 becomes 0.0
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) * size
            starts = np.concatenate([[0], ends[:-1]])
            nodes = [hashlib.md5(label.encode("utf-8", "surrogatepass") + b"\0" + data[a:b]).digest() for label, a, b in zip(labels, starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names=["vec_id", "label", "vector", "node"])

    return rows.where("vector is not null").mapInArrow(run, "vec_id long, label string, vector array<float>, node binary" if size == 4 else "vec_id long, label string, vector array<double>, node binary")


def _sided(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the sides of the first lines that the vector lies on, as one number."""
    nodes_at, schema = nodes.columns.index("vector"), StructType([*nodes.schema.fields, StructField("side", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(nodes_at)
            lengths, side = column.value_lengths().to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, dtype=np.int32)
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dims)
                if dims not in lines:
                    lines[dims] = directions(dims)[:, :SIDES]
                side[at] = ((unit(flat) @ lines[dims]) > 0) @ (1 << np.arange(SIDES)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(side, pa.int32())], names=[*batch.schema.names, "side"])

    return nodes.mapInArrow(run, schema)


BLOCKS = "label string, dims int, nodes binary, copies binary, vectors binary, low array<double>, high array<double>"


def _blocks(nodes: DataFrame, n: int) -> DataFrame:
    """Vectors of one label and length, neighbours together, packed into blocks; with the range of each line."""
    dealt = _sided(nodes).withColumn("dims", F.size("vector")).repartitionByRange(n, "label", "dims", "side", "node") \
        .sortWithinPartitions("label", "dims", "side", "node").select("label", "dims", "node", "copies", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(label, dims, parts):
            nodes_, copies, flat = (np.concatenate(x) if k else b"".join(x) for k, x in enumerate(zip(*parts)))
            on = unit(flat.reshape(-1, dims)) @ directions(dims)
            out = [label, dims, nodes_, copies.astype("<i8").tobytes(), flat.tobytes(), on.min(axis=0).tolist(), on.max(axis=0).tolist()]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, out))], schema=schema)

        schema = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("nodes", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        key, parts, held = None, [], 0
        for batch in batches:
            labels, dims = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            codes = labels.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                now = labels[a].as_py(), int(dims[a])
                if now != key and held:
                    yield packed(*key, parts)
                    parts, held = [], 0
                key = now
                while a < b:
                    some = batch.slice(a, min(b - a, BLOCK - held))
                    parts.append((b"".join(some.column(2).to_pylist()), some.column(3).to_numpy(zero_copy_only=False), some.column(4).flatten().to_numpy(zero_copy_only=False)))
                    held, a = held + some.num_rows, a + some.num_rows
                    if held == BLOCK:
                        yield packed(*key, parts)
                        parts, held = [], 0
        if held:
            yield packed(*key, parts)

    return dealt.mapInArrow(run, BLOCKS)


def _meetings(blocks: DataFrame, count: int, width: float) -> DataFrame:
    """(a, b) ids of blocks, a <= b, that can hold a pair with ``count`` collisions."""
    ends = blocks.select("id", "label", "dims", "low", "high")
    slots = ends.groupBy("label", "dims").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    ends = ends.join(slots, ["label", "dims"])
    left = ends.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")).select("label", "dims", "slot", F.col("id").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    right = ends.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select("label", "dims", "slot", F.col("id").alias("b"), "low", "high")
    meet = F.aggregate(F.sequence(F.lit(0), F.lit(LINES - 1)), F.lit(0), lambda n, k: n + F.when((F.get("low_a", k) - width <= F.get("high", k)) & (F.get("low", k) - width <= F.get("high_a", k)), 1).otherwise(0))
    return left.join(right, ["label", "dims", "slot"]).where("a <= b").where(meet >= count).select("a", "b")


def _met(pairs: DataFrame, blocks: DataFrame, kind: str, count: int, width: float, least: float) -> DataFrame:
    """(node, links, root): of each meeting and vector with links, how many, and one vector it is connected to."""
    def side(name: str) -> DataFrame:
        return blocks.select(F.col("id").alias(name), F.col("dims").alias(f"dims_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in ("nodes", "copies", "vectors")])

    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "dims_a", "nodes_a", "copies_a", "vectors_a", "nodes_b", "copies_b", "vectors_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["a"] == row["b"]
                one, two = (unit(np.frombuffer(row[f"vectors_{x}"], kind).reshape(-1, row["dims_a"])) for x in "ab")
                of_one, of_two = (np.frombuffer(row[f"copies_{x}"], "<i8") for x in "ab")
                shift = 0 if same else len(one)
                links, groups = np.zeros(shift + len(two), dtype=np.int64), Union(shift + len(two))
                for x, y in linked(one, two, count, width, least):
                    if same:
                        once = x < y
                        x, y = x[once], y[once]
                    y = y + shift
                    links += np.bincount(x, weights=of_two[y - shift], minlength=len(links)).astype(np.int64)
                    links += np.bincount(y, weights=of_one[x], minlength=len(links)).astype(np.int64)
                    groups.join(x, y)
                places = row["nodes_b"] if same else row["nodes_a"] + row["nodes_b"]
                at = np.flatnonzero(links)
                node = lambda k: places[16 * k:16 * k + 16]
                yield pa.RecordBatch.from_arrays([pa.array([node(k) for k in at.tolist()], pa.binary()), pa.array(links[at]), pa.array([node(k) for k in groups.find(at).tolist()], pa.binary())], names=["node", "links", "root"])

    return full.mapInArrow(run, "node binary, links long, root binary")


def link(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``."""
    rows, spark = _rows(vectors), vectors.sparkSession
    count, width = calibrated(), window(least)
    kind = "<f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    nodes = _nodes(rows)
    distinct = nodes.groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    distinct = shared.written(distinct, "distinct-vectors")
    blocks = _blocks(distinct, max(1, -(-distinct.count() // BLOCK))).withColumn("id", F.monotonically_increasing_id())
    blocks = shared.written(blocks, "vector-blocks")
    with shared.rows_per_batch(spark, 4):           # a row holds two blocks
        met = shared.written(_met(_meetings(blocks, count, width), blocks, kind, count, width, least), "links")

    found = components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = distinct.select("node", "copies", "least").join(met.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(found, "node", "left")
    placed = placed.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.coalesce("component", "node").alias("component"))
    placed = shared.written(placed, "placed-vectors")
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    done = nodes.select("vec_id", "node").join(placed.join(ids, "component").select("node", "n_links", "component_id"), "node")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.select("vec_id", "n_links", "component_id").union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
