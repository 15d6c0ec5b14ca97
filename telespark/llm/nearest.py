"""Operator 6: nearest vectors by inner product over randomly rotated one-bit codes.

A vector's residual to the mean is turned by a random rotation (of the vector padded to ``BITS``
dimensions); the signs are its code. Two correction scalars are kept: the residual's length, and its
cosine to its own code. For a query they give an unbiased estimate of the inner product and a bound
of its error; only vectors whose upper bound reaches the k-th largest lower bound of their block are
reranked by the original vectors in double precision.

The query set meets all blocks of the index, a block of queries at a time; from each meeting the k
best of a query go on. Equal vectors are indexed once, with their k + 1 smallest ids, so a vector
that makes up a third of all rows costs one code, and ties still go to the smallest ids.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, neither do rows without an id; repeated rows count once; fewer
than k candidates are all returned; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm import shared

BITS = 512
SURE = 3.0              # width of the bounds: the chance that one fails falls with exp(-SURE**2 / 2)
BLOCK = 8192            # codes in a row of the index
QUERIES = 512           # queries in a row of the query table
SEED = 6


def rotation(dims: int, bits: int) -> np.ndarray:
    """``dims`` orthonormal rows of ``bits`` values: the padded dimensions of a random rotation."""
    bits = max(bits, -(-dims // 8) * 8)
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((bits, dims)))
    return (q * np.sign(np.diag(r))).T


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, residual lengths, cosines between residual and code)."""
    residual = vectors - mean
    length = np.linalg.norm(residual, axis=1)
    turned = residual @ turn
    cosine = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, cosine, 1)


def bounds(codes: np.ndarray, length: np.ndarray, cosine: np.ndarray, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by vectors), and the half width of their bounds."""
    bits = turn.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    raw = (queries @ turn).astype(np.float32) @ signs.T / np.float32(np.sqrt(bits))
    estimate = (queries @ mean)[:, None] + raw * (length / cosine)[None, :]
    spread = length * np.sqrt(np.maximum(0, 1 - cosine ** 2)) / cosine * SURE / np.sqrt(bits - 1)
    return estimate, np.linalg.norm(queries, axis=1)[:, None] * spread[None, :] + 1e-6


def best(ids: np.ndarray, vectors: np.ndarray, codes, length, cosine, queries: np.ndarray, mean, turn, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query: ids and exact scores of its k nearest in the block."""
    k = min(k, len(ids))
    estimate, width = bounds(codes, length, cosine, queries, mean, turn)
    least = np.partition(estimate - width, len(ids) - k, axis=1)[:, len(ids) - k]
    for query, row, floor in zip(queries, estimate + width, least):
        at = np.flatnonzero(row >= floor)
        score = (vectors[at].astype(np.float64) * query).sum(axis=1)
        pick = np.lexsort((ids[at], -score))[:k]
        yield ids[at[pick]], score[pick]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) rows that take part, each once, and the number of dimensions."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    dims = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    return rows.where(F.size("embedding") == (dims.n if dims else 0)).distinct(), dims.n if dims else 0


INDEX = "part int, ids binary, vectors binary, codes binary, length binary, cosine binary"


def _blocks(rows: DataFrame, most: int, pack, schema: str) -> DataFrame:
    """Rows (class_id, embedding) gathered into packed rows of at most ``most``."""
    types = [pa.int32() if f.dataType.typeName() == "integer" else pa.binary() for f in rows.sparkSession.createDataFrame([], schema).schema]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(ids, vectors):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(pack(ids, vectors), types)], names=names)

        ids, vectors, n = [], [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                vectors.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                n += part.num_rows
                while n >= most:
                    i, v = np.concatenate(ids), np.concatenate(vectors)
                    yield row(i[:most], v[:most])
                    ids, vectors, n = [i[most:]], [v[most:]], n - most
        if n:
            yield row(np.concatenate(ids), np.concatenate(vectors))

    return rows.mapInArrow(run, schema)


def nearest(vectors: DataFrame, wanted, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for each row whose vec_id fulfils ``wanted``."""
    rows, dims = usable(vectors)
    spark = rows.sparkSession
    rows = shared.written(rows, "vectors")
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal vectors: the k + 1 smallest ids (the limit is applied before the copies meet)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    members = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).withColumn("class_id", F.first("vec_id").over(same))
    members = shared.written(members.select("class_id", "vec_id", "embedding"), "members")
    heads = members.where("class_id = vec_id").select("class_id", "embedding")
    count, *mean = heads.agg(F.count("*"), *[F.avg(F.col("embedding")[i]) for i in range(dims)]).first()
    mean, turn = np.array(mean), rotation(dims, BITS)
    n = -(-count // BLOCK)

    def pack_index(ids, vectors):
        codes, length, cosine = encode(vectors.astype(np.float64), mean, turn)
        return int(ids[0] % parts), ids.astype("<i8").tobytes(), vectors.astype("<f4").tobytes(), codes.tobytes(), length.tobytes(), cosine.tobytes()

    parts = max(1, min(n, shared.partitions(spark)))
    index = shared.written(_blocks(heads.repartition(n), BLOCK, pack_index, INDEX), "one-bit-index")
    asked = rows.where(wanted(F.col("vec_id"))).join(heads, "embedding").select("vec_id", "class_id")
    asked = shared.written(asked, "asked")
    asked_heads = heads.join(asked.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "embedding")
    questions = _blocks(asked_heads.repartition(max(1, n // 2)), QUERIES, lambda ids, v: (ids.astype("<i8").tobytes(), v.astype("<f4").tobytes()), "asked binary, queries binary")
    questions = questions.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vecs, codes, length, cosine, asked_ids, queries in zip(*(c.to_pylist() for c in batch.columns)):
                ids, asked_ids = np.frombuffer(ids, "<i8"), np.frombuffer(asked_ids, "<i8")
                vecs, queries = np.frombuffer(vecs, "<f4").reshape(-1, dims), np.frombuffer(queries, "<f4").reshape(-1, dims).astype(np.float64)
                found = list(best(ids, vecs, np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(length), np.frombuffer(cosine), queries, mean, turn, k + 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked_ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["of", "class_id", "score"])

    pairs = index.join(questions, "part").select("ids", "vectors", "codes", "length", "cosine", "asked", "queries")
    scored = pairs.mapInArrow(meet, "of long, class_id long, score double")
    top = scored.withColumn("nth", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "class_id"))).where(F.col("nth") <= k + 1)
    top = shared.written(top.select("of", "class_id", "score"), "nearest")
    full = asked.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("of")).join(top, "of") \
        .join(members.select("class_id", "vec_id"), "class_id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
