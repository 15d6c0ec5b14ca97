"""Operator 1: token-id files under one canonical, length-limited Huffman code.

The corpus is encoded once, ids are counted over all of it, and one code is built from the global
counts (package-merge, so no code is longer than ``limit`` bits). Files are Parquet tables of
segments. A segment holds whole documents and one bit stream, cut into blocks of ``BLOCK`` ids;
``block_bits`` has the bit offset at which each block starts, so blocks decode independently: the
table-driven decoder walks all blocks of a segment side by side.

Defined cases: a null or empty text holds the end id alone; null ``doc_id`` sorts first; rows that
share a ``doc_id`` follow each other in the order of their ids; an empty corpus gives empty files;
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.llm import shared
from telespark.llm.byte_bpe import ByteEncoder

BLOCK = 256             # ids in an independently decoded block
SEGMENT = 1 << 19       # ids after which a segment is closed
LIMIT = 18              # longest code in bits: the decoding table has 2**LIMIT entries


# ----------------------------------------------------------------------------------------------- the code

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (0: the id does not occur).

    Package-merge: on each level the symbols are merged with the pairs of the level above; as all
    lists are sorted, the items in use are a prefix of each level, and its symbols get one bit more.
    """
    counts = np.asarray(counts, dtype=np.int64)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used]
    levels, items = [], weights
    for _ in range(limit):
        levels.append(None)
        if len(levels) == 1:
            symbol = np.ones(n, dtype=bool)
        else:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([weights, pairs])
            order = np.argsort(both, kind="stable")
            items, symbol = both[order], order < n
        levels[-1] = symbol
    bits, taken = np.zeros(n, dtype=np.uint8), 2 * n - 2
    for symbol in reversed(levels):
        symbols = int(symbol[:taken].sum())
        bits[:symbols] += 1
        taken = 2 * (taken - symbols)
    lengths[used] = bits
    return lengths


class Code:
    """Canonical codes of given lengths: shorter codes first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.uint8)
        ids = np.flatnonzero(self.lengths)
        self.ids = ids[np.argsort(self.lengths[ids], kind="stable")]
        sizes = self.lengths[self.ids].astype(np.int64)
        self.longest = int(sizes.max(initial=1))
        self.spans = np.int64(1) << (self.longest - sizes)          # share of the code space, and of the table
        codes = (np.cumsum(self.spans) - self.spans) >> (self.longest - sizes)
        self.codes = np.zeros(len(self.lengths), dtype=np.uint64)
        self.codes[self.ids] = codes
        self._table = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream of the ids, and the bit offset of each block."""
        sizes = self.lengths[ids].astype(np.int64)
        if len(ids) and not sizes.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(sizes)
        starts = ends - sizes
        stream = np.zeros((int(ends[-1]) + 7) // 8 + 4 if len(ids) else 0, dtype=np.uint8)
        if len(ids):
            # a code and its shift fill at most four bytes; bits of different ids never meet, so adding is joining
            words = self.codes[ids] << (32 - sizes - (starts & 7)).astype(np.uint64)
            first = starts >> 3
            for k in range(4):
                part = (words >> np.uint64(24 - 8 * k)) & np.uint64(255)
                stream += np.bincount(first + k, weights=part, minlength=len(stream)).astype(np.uint8)
        return stream.tobytes(), starts[::BLOCK]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for every value of the next ``longest`` bits."""
        if self._table is None:
            symbol = np.repeat(self.ids, self.spans).astype(np.uint32)
            size = np.repeat(self.lengths[self.ids], self.spans).astype(np.int64)
            rest = (1 << self.longest) - len(symbol)
            self._table = np.pad(symbol, (0, rest)), np.pad(size, (0, rest), constant_values=1)
        return self._table

    def decode(self, stream: bytes, block_bits: np.ndarray, n: int) -> np.ndarray:
        """All ``n`` ids: step k reads id k of every block."""
        symbol, size = self.table()
        data = np.frombuffer(stream, dtype=np.uint8).astype(np.uint32)
        out = np.zeros((len(block_bits), BLOCK), dtype=np.uint32)
        if not n:
            return out.reshape(-1)
        ahead = np.zeros(len(data), dtype=np.uint32)                 # the 32 bits from each byte on
        for k in range(4):
            ahead[: len(data) - k] |= data[k:] << np.uint32(24 - 8 * k)
        at = np.array(block_bits, dtype=np.int64)
        last = n - (len(block_bits) - 1) * BLOCK                     # ids in the last block
        drop = np.uint32(32 - self.longest)
        for k in range(BLOCK):
            if k == last:
                at = at[:-1]
                if not len(at):
                    break
            bits = (ahead[at >> 3] << (at & 7).astype(np.uint32)) >> drop
            out[: len(at), k] = symbol[bits]
            at = at + size[bits]
        return out.reshape(-1)[:n]


# ----------------------------------------------------------------------------------------------- Spark side

def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every whole text and the end id, as little-endian bytes of ``ByteEncoder.width``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(tokenizer)
        end = end_id.to_bytes(encoder.width, "little")
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for low, high in shared.slices(texts):
                ids = [x + end for x in encoder.encode(texts[low:high])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array([len(x) // encoder.width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(ids: DataFrame, size: int, width: int) -> np.ndarray:
    """Occurrences of each id over the whole corpus: added up within tasks, then by id; at most ``size`` rows come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype=f"<u{width}"), minlength=size) if len(x.as_buffer()) > 4 * size else 0
            short = b"".join(x for x in batch.column(0).to_pylist() if len(x) <= 4 * size)
            total += np.bincount(np.frombuffer(short, dtype=f"<u{width}"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, dtype=np.int64)
    for row in rows:
        counts[row.id] = row.n
    return counts


SEGMENTS = "first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, block_bits array<long>, bits binary"


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, limit: int = LIMIT) -> None:
    """Encode ``docs`` (doc_id, text) into ``path``: ``segments`` in ascending doc_id, and ``code`` (id, length).

    Ids are written to the shared folder once and counted there; the buckets of the doc_id ranges
    get the number of their first token from per-bucket sums. No more than one row for each id of
    the vocabulary and one for each bucket reaches the driver.
    """
    spark = docs.sparkSession
    size, width = ByteEncoder.shape(tokenizer, end_id)
    ids = shared.written(encoded(docs, tokenizer, end_id), "token-ids")
    lengths = code_lengths(id_counts(ids, size, width), limit)
    n = shared.partitions(spark)
    bounds = shared.range_bounds(ids, "doc_id", 2 * n)
    placed = ids.withColumn("bucket", shared.range_bucket("doc_id", bounds))
    sums = {r.bucket: r.n for r in placed.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for bucket in sorted(sums):
        base[bucket], total = total, total + sums[bucket]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, open_bucket, done, held = Code(lengths), None, 0, []

        def close() -> pa.RecordBatch:
            nonlocal done, held
            stream = np.frombuffer(b"".join(x for _, x in held), dtype=f"<u{width}")
            bits, offsets = code.encode(stream)
            values = [done, len(stream), [d for d, _ in held], [len(x) // width for _, x in held], offsets, bits]
            done, held = done + len(stream), []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        names = ["first_token", "n_tokens", "doc_ids", "doc_tokens", "block_bits", "bits"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        waiting = 0
        for batch in batches:
            for bucket, doc_id, x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (bucket != open_bucket or waiting + len(x) // width > SEGMENT):
                    yield close()
                    waiting = 0
                if bucket != open_bucket:
                    open_bucket, done = bucket, base[bucket]
                held.append((doc_id, x))
                waiting += len(x) // width
        if held:
            yield close()

    sorted_ids = placed.select("bucket", "doc_id", "ids").repartition(n, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "ids")
    sorted_ids.mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(f"{path}/segments")
    used = np.flatnonzero(lengths)
    code = spark.createDataFrame([(int(i), int(lengths[i])) for i in used] + [(size, width)], "id long, length int")
    code.coalesce(1).write.parquet(f"{path}/code")


def _documents(spark: SparkSession, path: str, schema: str, names: list[str], make: Callable) -> DataFrame:
    """Decodes the files; ``make(doc_ids, starts, stream, first, until)`` gives the columns of a segment's documents,
    whose ids are at ``first`` to ``until`` of the stream (unsigned 32-bit little-endian)."""
    lengths = _lengths(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for start, n, doc_ids, doc_tokens, offsets, bits in zip(*(c.to_pylist() for c in batch.columns)):
                stream = code.decode(bits, np.array(offsets, dtype=np.int64), n).astype("<u4").tobytes()
                tokens = np.array(doc_tokens, dtype=np.int64)
                until = np.cumsum(tokens)
                first = until - tokens
                yield pa.RecordBatch.from_arrays(make(pa.array(doc_ids, pa.int64()), pa.array(first + start, pa.int64()), stream, first.tolist(), until.tolist()), names=names)

    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    return segments.mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents of ``write_files`` with all their ids, unsigned 32-bit little-endian."""
    def make(doc_ids, starts, stream, first, until):
        return [doc_ids, starts, pa.array([stream[4 * a:4 * b] for a, b in zip(first, until)], pa.binary())]

    return _documents(spark, path, "doc_id long, start long, ids binary", ["doc_id", "start", "ids"], make)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents read back from the files."""
    def make(doc_ids, starts, stream, first, until):
        view = memoryview(stream)
        return [doc_ids, starts, pa.array([b - a for a, b in zip(first, until)], pa.int64()), pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(first, until)], pa.int64())]

    return _documents(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", ["doc_id", "start", "n_tokens", "ids_crc32"], make)


def _lengths(spark: SparkSession, path: str) -> np.ndarray:
    """The code table has a row for each id that occurs; its last id marks the vocabulary's size."""
    rows = spark.read.schema("id long, length int").parquet(f"{path}/code").collect()
    lengths = np.zeros(max(r.id for r in rows) + 1, dtype=np.uint8)
    for r in rows:
        lengths[r.id] = r.length
    return lengths[:-1]

