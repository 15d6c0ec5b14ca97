"""Operator 8: near-duplicate classes by ProbMinHash, banding and exact verification.

Documents are multisets of ``WORDS``-word shingles; likeness is the probability Jaccard similarity
J_P of the shingle counts (the plain Jaccard similarity where no shingle repeats). ProbMinHash: each
shingle is a Poisson process whose rate is its count; its arrivals fall into random registers, a
register keeps the shingle of its first arrival, and a process ends once it is later than all
registers. Two documents agree in a register with probability J_P. ``BANDS`` bands of ``ROWS``
registers give candidates (at J_P 0.8 one pair in 20 million is missed), which are verified by J_P of the whole texts.

Exact copies are one node from the start. In each band bucket the members are compared with one of
them, not with each other. Buckets that then hold several components are joined to families, and
these are settled in blocks of bounded size: longer signatures rank the pairs of different
components, and those that may reach the threshold are verified from the most likely down, unless a
link found before has joined them. Only links leave a block; so no link between components is lost,
and no pairs inside a component are made.

Defined cases: a null text is an empty one; texts without words are alike only to equal texts; texts
of fewer than ``WORDS`` words are one shingle; repeated rows and rows that share a doc_id are told
apart by their texts; the class id is the smallest doc_id of the class (null if it has none); an empty table gives an
empty one; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.llm import shared
from telespark.llm.components import components
from telespark.llm.hashing import joined_words, mixed

WORDS = 5
LEAST = 0.8
BANDS = 32
ROWS = 4
MEMBERS = 1000          # of a family in a block; blocks meet in pairs
LONG = 512              # registers that rank the pairs of a block
DOUBT = 5.0             # standard errors under the threshold from which pairs are verified
SLICE = 1 << 21         # characters signed together
FEW = 500               # pairs that are verified one by one
SWEPT = 1 << 23         # characters of a block whose shingles are counted together


# ------------------------------------------------------------------------------------------- signatures

def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles of each text."""
    data, counts = joined_words(texts)
    if not len(data.starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    per = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), per)
    first = (np.cumsum(counts) - counts)[text] + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    hashes = data.hashes(first, np.minimum(first + words, np.cumsum(counts)[text]))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])]))
    return text[new], hashes[new], np.diff(np.concatenate([new, [len(text)]]))


def signatures(texts: list[str], size: int = BANDS * ROWS, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have words, and the registers of those."""
    text, hashes, counts = shingles(texts, words)
    have, row = np.unique(text, return_inverse=True)
    first = np.full(len(have) * size, np.inf)           # arrival time of each register
    winner = np.zeros(len(have) * size, dtype=np.uint64)
    now, state = np.zeros(len(row)), mixed(hashes + np.uint64(0x632BE59BD9B4E019))
    end = np.full(len(have), np.inf)
    while len(row):
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        now = now - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / counts
        register = row * size + (mixed(state ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, register, now)
        won = first[register] == now
        winner[register[won]] = hashes[won]
        open_rows = np.unique(row)
        end[open_rows] = first.reshape(-1, size)[open_rows].max(axis=1)
        go = now < end[row]
        row, hashes, counts, now, state = row[go], hashes[go], counts[go], now[go], state[go]
    return have, winner.reshape(-1, size)


def bands(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    parts = registers.reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two multisets, each (ascending hashes, counts): sum over x of 1 / sum over y of max(a(y)/a(x), b(y)/b(x))."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    ratio = x / y
    # shingles only in a have an infinite ratio, those only in b a ratio of 0
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]]) + (a[1].sum() - x.sum())
    below = np.concatenate([[0.0], np.cumsum(y)]) + (b[1].sum() - y.sum())
    cut = np.searchsorted(ratio, ratio, side="left")
    return float((1 / (above[cut] / x + below[cut] / y)).sum())


# ------------------------------------------------------------------------------------------- Spark side

def _node(text: Column) -> Column:
    """Equal texts are one node."""
    return F.unhex(F.md5(text.cast("binary")))


def _keys(docs: DataFrame) -> DataFrame:
    """(node, keys): band keys of (node, text) rows that have words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.forget()
        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in shared.slices(texts, SLICE):
                have, registers = signatures(texts[low:high])
                keys = bands(registers)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([nodes[low:high].take(pa.array(have)), lists], names=["node", "keys"])

    return docs.mapInArrow(run, "node binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of the (a, b) pairs whose texts have a J_P of ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}

        def bag(node, text):
            if node not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[node] = shingles([text])[1:]
            return seen[node]

        for batch in batches:
            a, b, one, two = (c.to_pylist() for c in batch.columns)
            near = [probability_jaccard(bag(*x), bag(*y)) >= least for x, y in zip(zip(a, one), zip(b, two))]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    one, two = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "one"), ("b", "two")))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return full.mapInArrow(run, "a binary, b binary")


def _unsettled(member: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, component) of the buckets with several components and more than the two members compared at first."""
    placed = member.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    keys = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n")).where("c < d and n > 2").select("key")
    return placed.join(keys, "key", "left_semi")


class _Groups:
    """Which members are connected by now."""

    def __init__(self, of: list[bytes]):
        self.root = {x: x for x in of}

    def find(self, x: bytes) -> bytes:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x


def long_registers(texts: list[str]) -> np.ndarray:
    """``LONG`` registers of each text; all of them have words."""
    parts = [signatures(texts[low:high], LONG)[1].astype(np.uint32) for low, high in shared.slices(texts, SLICE)]     # the lower halves
    return np.concatenate(parts) if parts else np.empty((0, LONG), np.uint32)


def may_reach(texts: list[str], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (i, j) of texts may have a J_P of ``least``: for texts that repeat no shingle it is the plain
    Jaccard similarity, and one sweep over all shingles counts what a text shares with every other."""
    out = np.ones(len(i), dtype=bool)
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    if len(i) < FEW or sum(len(texts[n]) for n in used.tolist()) > SWEPT:
        return out
    text, hashes, counts = shingles([texts[n] for n in used.tolist()])
    size, once = (np.bincount(text, weights=w, minlength=len(used)) for w in (None, counts == 1))
    if not size.all():
        return out
    plain, ids = once == size, np.unique(hashes, return_inverse=True)[1]
    starts, mark = np.cumsum(size) - size, np.zeros(len(ids), dtype=np.int32)
    a, b = at[: len(i)], at[len(i):]
    order = np.argsort(a, kind="stable")
    for pairs in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        x, y = a[pairs[0]], b[pairs]
        if plain[x]:
            own = ids[starts[x]: starts[x] + size[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids], starts)[y]
            mark[own] = 0
            out[pairs] = ~plain[y] | (both / (size[x] + size[y] - both) >= least - 1e-9)
    return out


def settle(nodes: list[bytes], of: list[bytes], side: np.ndarray, texts: list[str], least: float, registers: np.ndarray | None = None) -> list[tuple[bytes, bytes]]:
    """Links that join components among the pairs of a block (``side`` all 0) or between two blocks (0 and 1).
    ``registers``: those of ``long_registers``, if they are there already."""
    groups, links, bags = _Groups(of), [], {}
    crossing = bool(side.any())
    names, number = np.unique(np.array(of, dtype=object), return_inverse=True)
    largest = np.bincount(number).argmax()
    # every pair of different components has a member outside the largest one
    rest, every = np.flatnonzero(number != largest), np.arange(len(nodes))
    here = side == 0
    meet = [(rest[here[rest]], every[~here]), (every[here & (number == largest)], rest[~here[rest]])] if crossing else [(rest, every)]
    if len(nodes) > 24 and registers is None:
        registers = long_registers(texts)
    found = []
    for left, right in meet:
        if len(nodes) > 24:
            near = np.zeros((len(left), len(right)), dtype=np.int16)
            for k in range(LONG):
                near += registers[left, k][:, None] == registers[right, k][None, :]
        else:
            near = np.full((len(left), len(right)), LONG, dtype=np.int16)
        ok = near >= LONG * (least - DOUBT * np.sqrt(least * (1 - least) / LONG))
        ok &= number[left][:, None] != number[right][None, :]
        i, j = np.nonzero(ok)
        found.append((left[i], right[j], near[i, j]))
    i, j, near = (np.concatenate(x) for x in zip(*found))
    once = crossing | (number[j] == largest) | (i < j)
    i, j, near = i[once], j[once], near[once]
    likely = may_reach(texts, i, j, least)
    i, j, near = i[likely], j[likely], near[likely]
    for at in np.argsort(-near, kind="stable").tolist():
        x, y = int(i[at]), int(j[at])
        a, b = groups.find(of[x]), groups.find(of[y])
        if a == b:
            continue
        for n in (x, y):
            if n not in bags:
                bags[n] = shingles([texts[n]])[1:]
        if probability_jaccard(bags[x], bags[y]) >= least:
            groups.root[a] = b
            links.append((nodes[x], nodes[y]))
    return links


def _signed(members: DataFrame) -> DataFrame:
    """``members`` with the long registers of their texts: worked out once, however many blocks they meet in."""
    columns = ("node", "component", "family", "blocks", "block", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.forget()
        for batch in batches:
            for low in range(0, batch.num_rows, MEMBERS):
                part = batch.slice(low, MEMBERS)
                registers = long_registers(part.column(len(columns) - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in registers], pa.binary())], names=[*columns, "registers"])

    return members.select(*columns).mapInArrow(run, "node binary, component binary, family binary, blocks int, block int, text string, registers binary")


def _settled(open_members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b) links between components of the same family."""
    open_members = shared.written(open_members, "open")
    roots = open_members.groupBy("key").agg(F.min("node").alias("b"))
    family = components(open_members.join(roots, "key").where("node <> b").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "family")
    sizes = family.groupBy("family").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    placed = open_members.select("node", "component").distinct().join(family, "node").join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = _signed(placed.join(texts, "node")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "component", "family", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "text", "registers")

    def run(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_pylist() for c in ("node", "component", "block", "low", "high", "text")}
        registers = np.frombuffer(b"".join(group.column("registers").to_pylist()), dtype=np.uint32).reshape(-1, LONG)
        links = settle(columns["node"], columns["component"], np.array(columns["block"]) != columns["low"][0], columns["text"], least, registers)
        return pa.table([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

    return met.groupBy("family", "low", "high").applyInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(row, node, class_node, class_id): every row of ``docs`` with the node of its text and its class."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("node", _node(F.col("text")))

    signed = shared.written(_keys(rows.select("node", "text")), "signatures")
    one_each = signed.groupBy("node").agg(F.first("keys").alias("keys"))        # copies have equal keys
    member = one_each.select("node", F.explode("keys").alias("key"))
    # buckets of two texts or more; the smallest and the largest node tell without gathering the bucket
    bucket = member.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    member = shared.written(member.join(bucket, "key"), "members")
    texts = rows.select("node", "text").join(member.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = shared.written(texts, "candidate-texts")

    pairs = member.where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    links = shared.written(verified(pairs, texts, least), "links")
    found = components(links)

    more = shared.written(_settled(_unsettled(member, found), texts, least), "links")
    if not more.isEmpty():
        found = components(links.union(more))

    by_node = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(found, "node", "left").withColumn("class_node", F.coalesce("component", "node"))
    heads = by_node.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "node")).alias("head"))
    heads = by_node.join(heads, "class_node").select("node", F.col("head.node").alias("class_node"), F.col("head.doc_id").alias("class_id"))
    return rows.select("row", "node").join(heads, "node").select("row", "node", "class_node", "class_id")


def keep_first(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` without those that are near copies of another: the smallest doc_id of each class stays, one row of it."""
    found = classes(docs, least).where("node = class_node and row.doc_id <=> class_id")
    # equal rows of one doc_id: any one of them; rows are already dealt out by node
    first = found.groupBy("node").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return first.select("row.*")
