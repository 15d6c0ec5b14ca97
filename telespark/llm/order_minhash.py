"""Operator 5: fingerprints of whole texts by Order MinHash.

The k-mers of a text (``K`` code points) are numbered by occurrence, so each (k-mer, occurrence) is
unique. Each of ``SIZE`` hash functions selects the ``ELL`` smallest of them, puts these back into
the order of the text, and hashes the tuple: two texts agree in a place only where they share the
selected k-mers *and* their order, which follows the edit distance and not the set of k-mers alone.
The likeness of two fingerprints is the share of equal places.

Defined cases: a null text counts as empty; an empty text has a fingerprint of its own, like only to
itself; a text of at most ``K`` code points is one k-mer; with fewer than ``ELL`` k-mers all are
taken. Equal texts have equal fingerprints. Documents follow each other by descending doc_id, rows
of one doc_id by text, null ids last; in a table of one row a document is followed by itself. An
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm import shared

K = 6                   # code points of a k-mer
ELL = 2                 # k-mers in a tuple
SIZE = 64               # tuples in a fingerprint
WIDE = 1 << 15          # k-mers hashed by all functions at once

_MULT = (np.random.Generator(np.random.PCG64(20)).integers(1 << 62, size=(SIZE, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _numbered(text: str) -> np.ndarray:
    """A 64-bit hash of each (k-mer, occurrence), in text order."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    k = min(K, len(letters))
    n = len(letters) - k + 1
    mers = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        mers = mers * np.uint64(0x9E3779B97F4A7C15) + letters[i: i + n]
    mers = _mix(mers)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    # equal k-mers side by side in text order: the hash above, the place in the low bits
    ordered = np.sort((mers >> bits << bits) | np.arange(n, dtype=np.uint64))
    place = (ordered & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    head = ordered >> bits
    again = np.flatnonzero(head[1:] == head[:-1]) + 1
    if len(again):
        new = np.ones(n, dtype=bool)
        new[again] = False
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        number = (np.arange(n) - first)[again].astype(np.uint64)
        mers[place[again]] += _mix(number + np.uint64(1)) << np.uint64(1)
    return _mix(mers)


def fingerprint(text: str) -> np.ndarray:
    """``SIZE`` unsigned 64-bit tuple hashes."""
    if not text:
        return np.arange(SIZE, dtype=np.uint64)
    mers = _numbered(text)
    n, ell = len(mers), min(ELL, len(mers))
    rows = np.arange(SIZE)
    best = np.empty((SIZE, 0), dtype=np.int64)          # places of the smallest so far
    values = np.empty((SIZE, 0), dtype=np.uint32)
    for low in range(0, n, WIDE):
        # the high half of a product by an odd number: another order of the k-mers for each function
        hashed = ((mers[None, low:low + WIDE] * _MULT) >> np.uint64(32)).astype(np.uint32)
        for _ in range(min(ell, hashed.shape[1])):
            at = hashed.argmin(axis=1)
            values = np.concatenate([values, hashed[rows, at][:, None]], axis=1)
            best = np.concatenate([best, at[:, None] + low], axis=1)
            hashed[rows, at] = 0xFFFFFFFF
    if best.shape[1] > ell:
        pick = np.argsort(values, axis=1, kind="stable")[:, :ell]
        best = np.take_along_axis(best, pick, axis=1)
    best.sort(axis=1)
    out = np.zeros(SIZE, dtype=np.uint64)
    for i in range(best.shape[1]):
        out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + mers[best[:, i]])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SIZE


def as_text(x: np.ndarray) -> str:
    return x.astype("<u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the start of the following text (or all it has)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, tail, doc_id, text): descending doc_id ranges as buckets in sorted partitions; each bucket ends with a copy of what follows it.

    The ranges come from a quantile sketch of the ids; one id for each bucket, not more, reaches the driver.
    """
    n = shared.partitions(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = shared.range_bounds(ids, "doc_id", 2 * n)
    # buckets count down the ids; rows without an id come after all others
    placed = ids.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - shared.range_bucket("doc_id", bounds)))
    heads = {r.bucket: r.head for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    to = F.array(*[F.lit(before.get(b)).cast("int") for b in range(len(bounds) + 2)])
    head = F.array(*[F.lit(heads.get(b)).cast("long") for b in range(len(bounds) + 2)])
    is_head = F.col("doc_id").eqNullSafe(F.get(head, F.col("bucket")))
    copies = F.when(is_head, F.array(F.struct("bucket", F.lit(False).alias("tail")), F.struct(F.get(to, F.col("bucket")).alias("bucket"), F.lit(True).alias("tail")))) \
        .otherwise(F.array(F.struct("bucket", F.lit(False).alias("tail"))))
    rows = placed.select(F.explode(copies).alias("c"), "doc_id", "text").select("c.bucket", "c.tail", "doc_id", "text")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to that and to the next document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []           # the row that waits for the next one: bucket, doc_id, text, fingerprint

        def row(doc_id, text, mark, after, after_mark):
            other = edited(text, after)
            other_mark = fingerprint(other) if other != text else mark
            return (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), as_text(mark), as_text(other_mark), likeness(mark, other_mark), likeness(mark, after_mark))

        for batch in batches:
            for bucket, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if tail and (held is None or held[0] != bucket):
                    continue            # a further row of the next bucket's first id
                mark = fingerprint(text)
                if held is not None and held[0] == bucket:
                    rows.append(row(*held[1:], text, mark))
                held = None if tail else (bucket, doc_id, text, mark)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
            rows = []

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return with_next(docs).mapInArrow(run, COLUMNS)
