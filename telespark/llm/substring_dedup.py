"""Operator 3: removal of word windows that start in an earlier document, by super-k-mers.

Every ``window`` consecutive words of a document are a window; its minimiser is the smallest hash of
its ``MER``-word sequences. Consecutive windows that share a minimiser travel as one packed string
(a super-k-mer) to the bucket of the minimiser, so equal windows always meet. In a bucket, windows
are sorted by a 64-bit hash of their bytes and runs of equal hashes are compared by their bytes:
counting is exact. All but the windows of the smallest doc_id are *beaten*; a word is removed if a
beaten window covers it.

Hot passages: windows beaten within one slice of a task are marked there and not sent, so a passage
that stands in a third of all documents is sent once for each slice. A bucket is read in pieces, and
after each piece only super-k-mers that may still win are held: memory follows distinct windows.

Defined cases: a null or empty text has no words; documents shorter than the window lose nothing; a
null ``doc_id`` is neither smaller nor larger than any, so such rows beat none and keep all; rows that
share a ``doc_id`` do not beat each other; an empty table gives an empty one; other columns, whatever
their names, are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telespark.llm import shared
from telespark.llm.hashing import Words, joined_words, mixed, sliding_min

WINDOW = 13             # words
MER = 3                 # words of the sequences that minimisers are taken from
SLICE = 1 << 22         # characters that a task looks at together
HELD = 1 << 23          # bytes of packed strings read before a bucket is gone through

def beaten(text: Words, first: np.ndarray, window: int, docs: np.ndarray) -> np.ndarray:
    """Which of the windows (by their first words) also stand in a document with a smaller id."""
    out = np.zeros(len(first), dtype=bool)
    hashes = text.hashes(first, first + window)
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    data, least, found = text.data, {}, []
    for a, b, d in zip(text.starts[first[at]].tolist(), text.ends[first[at] + window - 1].tolist(), docs[at].tolist()):
        window = data[a:b]
        if d < least.setdefault(window, d):
            least[window] = d
        found.append(window)
    out[at] = [least[window] < d for window, d in zip(found, docs[at].tolist())]
    return out


def runs(keep: np.ndarray, *apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 index of the runs of consecutive True values in which nothing of ``apart`` changes."""
    at = np.flatnonzero(keep)
    if not len(at):
        return at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1] + 1
    for x in apart:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], at[np.concatenate([first[1:], [len(at)]]) - 1] + 1


SENT = "bucket int, docs binary, kmers binary, packed binary"
MARKS = "doc_id long, key int, begin int, until int"


def _mark_batch(docs, keys, begins, untils) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((docs, pa.int64()), (keys, pa.int32()), (begins, pa.int32()), (untils, pa.int32()))], names=["doc_id", "key", "begin", "until"])


def _cut(ids: list[int], keys: list[int], texts: list[str], window: int, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Rows to send for one slice of documents; ``packed`` is empty in rows that carry marks made here."""
    if window < MER:
        raise ValueError(f"a window has at least {MER} words")
    text, counts = joined_words(texts)
    starts, ends = text.starts, text.ends
    n = len(starts) - window + 1
    if n < 1:
        return
    doc = np.repeat(np.arange(len(ids)), counts)                # of each word: place of its document in the slice
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    valid = doc[:n] == doc[window - 1:]
    ids, keys = np.array(ids, dtype=np.int64), np.array(keys, dtype=np.int32)

    at = np.flatnonzero(valid)
    lost = np.zeros(n, dtype=bool)
    lost[at] = beaten(text, at, window, ids[doc[at]])
    first, last = runs(lost, doc)
    pack = zstandard.ZstdCompressor(level=6).compress
    if len(first):
        of = doc[first]
        yield int(ids[0] % buckets), pack(ids[of].tobytes() + keys[of].tobytes()), pack(nth[first].astype("<i4").tobytes() + (nth[last - 1] + window).astype("<i4").tobytes()), b""

    word = text.word
    mers = word[: len(word) - MER + 1].copy()
    for k in range(1, MER):
        mers = mixed(mers * np.uint64(3)) ^ word[k: len(word) - MER + 1 + k]
    least = sliding_min(mixed(mers), window - MER + 1)
    first, last = runs(valid & ~lost, doc, least)
    bucket = (mixed(least[first]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    low, high = starts[first].tolist(), ends[last + window - 2].tolist()
    for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        of, place = np.unique(doc[first[group]], return_inverse=True)
        yield (int(bucket[group[0]]), pack(ids[of].tobytes() + keys[of].tobytes()),
               pack(place.astype("<u4").tobytes() + nth[first[group]].astype("<i4").tobytes()), pack(b"\n".join([text.data[low[i]:high[i]] for i in group.tolist()])))


class Bucket:
    """The super-k-mers of a bucket: what is left of those seen, and those not yet gone through."""

    def __init__(self, window: int):
        self.window, self.size = window, 0
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]] = []
        self.left = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), b"", np.empty(0, bool))

    def add(self, docs: bytes, kmers: bytes, packed: bytes) -> None:
        ids, keys = _halves(docs, "<i8", "<i4")
        place, begin = _halves(kmers, "<u4", "<i4")
        self.pieces.append((ids[place], keys[place], begin, packed))
        self.size += len(packed)

    def go(self) -> Iterator[pa.RecordBatch]:
        """Marks of the windows that are beaten by now."""
        if not self.pieces:
            return
        ids, keys, begin = (np.concatenate([self.left[k], *(p[k] for p in self.pieces)]) for k in range(3))
        data = b"\n".join([x for x in (self.left[3], *(p[3] for p in self.pieces)) if x])
        self.pieces, self.size = [], 0
        text = Words(data)
        line = np.concatenate([[0], np.cumsum(text.letters[text.ends[:-1]] == 10)])      # of each word: its super-k-mer
        per_line = np.bincount(line, minlength=len(ids))
        at = np.flatnonzero(line[: len(line) - self.window + 1] == line[self.window - 1:])
        of = line[at]
        nth = at - (np.cumsum(per_line) - per_line)[of] + begin[of]
        lost = beaten(text, at, self.window, ids[of])
        said = np.concatenate([self.left[4], np.zeros(len(at) - len(self.left[4]), bool)])      # marks made before
        first, last = runs(lost & ~said, of)
        if len(first):
            yield _mark_batch(ids[of[first]], keys[of[first]], nth[first], nth[last - 1] + self.window)
        lost |= said
        keep = np.zeros(len(ids), dtype=bool)
        keep[of[~lost]] = True
        lines = data.split(b"\n")
        self.left = ids[keep], keys[keep], begin[keep], b"\n".join([lines[i] for i in np.flatnonzero(keep).tolist()]), lost[keep[of]]


def _halves(data: bytes, first: str, second: str) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.dtype(first).itemsize, np.dtype(second).itemsize
    n = len(data) // (a + b)
    return np.frombuffer(data, first, n), np.frombuffer(data, second, n, a * n)


def marks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, begin, until): word ranges to remove; ``key`` tells rows of one doc_id apart by their text. Input: (doc_id, key, text)."""
    n = shared.partitions(docs.sparkSession)
    buckets = 4 * n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.forget()
        for batch in batches:
            ids, keys, texts = (c.to_pylist() for c in batch.columns)
            for low, high in shared.slices(texts, SLICE):
                rows = list(_cut(ids[low:high], keys[low:high], texts[low:high], window, buckets))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "docs", "kmers", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, bucket = None, Bucket(window)
        for batch in batches:
            for number, a, b, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    yield from bucket.go()
                    now, bucket = number, Bucket(window)
                if packed:
                    bucket.add(unpack(a), unpack(b), unpack(packed))
                    if bucket.size > max(HELD, 2 * len(bucket.left[3])):
                        yield from bucket.go()
                else:
                    yield _mark_batch(*_halves(unpack(a), "<i8", "<i4"), *_halves(unpack(b), "<i4", "<i4"))
        yield from bucket.go()

    sent = docs.where("doc_id is not null and text is not null").select("doc_id", "key", "text").mapInArrow(cut, SENT)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, MARKS)


_KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


@F.pandas_udf(_KEPT)
def _kept(text: pd.Series, begins: pd.Series, untils: pd.Series) -> pd.DataFrame:
    rows = []
    for t, begin, until in zip(text, begins, untils):
        words = t.encode("utf-8", "surrogatepass").split() if t else []
        n = len(words)
        if begin is not None and len(begin):
            step = np.zeros(n + 1, dtype=np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, until, -1)
            stay = np.cumsum(step[:n]) == 0
            words = [words[i] for i in np.flatnonzero(stay).tolist()]
        rows.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, n_words, n_removed, kept): each row of ``docs`` as a struct, and its text without the repeated words."""
    text = F.col("row.text").cast("string")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    keyed = keyed.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.hash(text).alias("key"), "row")
    found = marks(keyed.select("doc_id", "key", text.alias("text")), window).groupBy("doc_id", "key").agg(F.collect_list(F.struct("begin", "until")).alias("spans"))
    # one row a document on the right: the left side may be split where it is large
    both = keyed.join(found, ["doc_id", "key"], "left")
    done = both.select("row", _kept(F.coalesce(text, F.lit("")), F.coalesce(F.col("spans.begin"), F.array().cast("array<int>")), F.coalesce(F.col("spans.until"), F.array().cast("array<int>"))).alias("k"))
    return done.select("row", "k.n_words", "k.n_removed", "k.kept")
