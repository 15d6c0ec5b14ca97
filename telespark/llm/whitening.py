"""Operator 11: whitening of integer vectors by spectrum slicing of their covariance.

An entry c becomes the whole number x = floor(64 c) + 1000000. One pass over the rows gives the number of rows
and the sums of x, a second one the products of y = x - (rounded mean), both as exact whole numbers that Spark adds up
as decimals; so the covariance is centred before anything is multiplied, and each entry is rounded once.

The leading eigenvalues are isolated by spectrum slicing: the signs of D in L D L^T of the covariance less
a shift count the eigenvalues above that shift, and intervals are halved until each holds one. Rayleigh quotient
iteration starts inside the interval and converges cubically; counts at both sides of the value found certify its
number. Eigenvalues that no shift can part are found together, by inverse iteration of as many vectors.

Defined cases: vectors that are null or hold null, non-finite entries or entries whose x is no long take no part,
neither do empty ones and those of another length than most (of equally many, the shorter); repeated rows and rows
without an id count like others; components without variance beyond rounding are left out, so equal vectors, a single
one or an empty table give no component; other columns are not read. Only matrices of dims x dims reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = 64
OFFSET = 1_000_000
LIMB = 22               # bits of the pieces whose products stay exact in double precision
ROWS = 512              # rows of a product of such pieces: 2 * 22 + 9 bits are the 53 of a double
NUMBERS = 1 << 20       # entries handled at once
LEAST = 1e-10           # variance of a component, as a part of the whole, below which it is rounding
EXACT = pa.decimal128(38, 0)


# ------------------------------------------------------------------------------------------- eigenvectors

def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive signs in L D L^T with blocks of one or two (diagonal pivoting)."""
    a = matrix - shift * np.eye(len(matrix))
    size, k, count, bound = len(a), 0, 0, (1 + 17 ** 0.5) / 8
    while k < size:
        column = np.abs(a[k + 1:, k])
        most = column.max(initial=0.0)
        block, at = 1, k
        if most and abs(a[k, k]) < bound * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < bound * most ** 2:
                at = r
                block = 1 if abs(a[r, r]) >= bound * row.max() else 2
        to = k + block - 1
        if at != to:
            a[[to, at]] = a[[at, to]]
            a[:, [to, at]] = a[:, [at, to]]
        rest = a[k + block:, k:k + block]
        if block == 1:
            if a[k, k]:
                count += a[k, k] > 0
                a[k + 1:, k + 1:] -= rest * (rest.T / a[k, k])
        else:
            count += 1                                  # such a block has one eigenvalue of each sign
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(a[k:k + 2, k:k + 2], rest.T)
        k += block
    return int(count)


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, grain: float) -> np.ndarray:
    for nudge in (0.0, grain, -grain, 4 * grain):
        try:
            found = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError("no shift near the eigenvalue gives a solution")


def _quotients(matrix: np.ndarray, low: float, high: float, start: np.ndarray, grain: float) -> tuple[float, np.ndarray] | None:
    """An eigenvalue in (low, high] by Rayleigh quotient iteration, or None if the iteration leaves the interval."""
    value, x, done = (low + high) / 2, start, False
    for step in range(16):
        x = _solve(matrix, value, x, grain)
        x /= np.linalg.norm(x)
        quotient = float(x @ matrix @ x)
        if low - grain <= quotient <= high + grain:
            value = quotient
        elif step > 2:
            return None
        if done:                                        # one step more than needed: to the last bits
            return (value, x) if value == quotient else None
        done = value == quotient and np.linalg.norm(matrix @ x - quotient * x) <= grain
    return None


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit vectors as columns; largest entry of each positive."""
    size = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if not norm:
        return np.zeros(min(most, size)), np.eye(size)[:, :most]
    grain = 4 * size * np.finfo(float).eps * norm       # counts are exact to so much
    rng = np.random.Generator(np.random.PCG64(11))
    values, vectors = [], []
    todo = [(-norm - grain, norm + grain, size, 0)]     # (low, high, eigenvalues above low, above high)
    while todo and len(values) < most:
        low, high, below, over = todo.pop()
        if below == over:
            continue
        if below - over == 1:
            found = _quotients(matrix, low, high, rng.standard_normal(size), grain)
            if found:
                up, down = min(found[0] + 2 * grain, high), max(found[0] - 2 * grain, low)
                if (over if up == high else above(matrix, up)) == over and (below if down == low else above(matrix, down)) == below:
                    values.append(found[0])
                    vectors.append(found[1])
                    continue
        if high - low <= 4 * grain:                     # no shift parts these
            x = rng.standard_normal((size, below - over))
            for _ in range(4):
                x, _ = np.linalg.qr(_solve(matrix, (low + high) / 2, x, grain))
            inner, turn = np.linalg.eigh(x.T @ matrix @ x)
            values.extend(inner[::-1].tolist())
            vectors.extend((x @ turn[:, ::-1]).T)
            continue
        middle = (low + high) / 2
        count = above(matrix, middle)
        todo += [(low, middle, below, count), (middle, high, count, over)]
    out: list[np.ndarray] = []
    for x in vectors[:most]:
        for _ in range(2):
            for y in out:
                x = x - (x @ y) * y
        x = x / np.linalg.norm(x)
        out.append(x * np.sign(x[np.abs(x).argmax()]))
    return np.array(values[:most]), np.array(out).reshape(len(out), size).T


# ------------------------------------------------------------------------------------------- Spark side

def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(embedding) of the rows that take part, of whatever length, next to their ``vec_id``."""
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("embedding"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 56))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fits))


def _whole(column: pa.Array, dims: int) -> Iterator[np.ndarray]:
    """x of vectors of one length, a bounded number of rows at a time."""
    step = max(1, NUMBERS // dims)
    for low in range(0, len(column), step):
        part = column.slice(low, step)
        c = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
        yield np.floor(UNITS * c).astype(np.int64) + OFFSET


def _added(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    high, low = x >> 31, x & ((1 << 31) - 1)
    return [(int(h) << 31) + int(l) for h, l in zip(high.sum(axis=0), low.sum(axis=0))]


def products(y: np.ndarray) -> np.ndarray:
    """Exact sums of the products of all pairs of columns, as whole numbers of any size."""
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    top = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if top ** 2 * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return out + (f.T @ f).astype(np.int64)
    count = -(-(top.bit_length() + 1) // LIMB)
    for low in range(0, len(y), ROWS):
        part = y[low:low + ROWS]
        pieces = [((part >> (LIMB * k)) & ((1 << LIMB) - 1) if k < count - 1 else part >> (LIMB * k)).astype(np.float64) for k in range(count)]
        for a, left in enumerate(pieces):
            for b, right in enumerate(pieces):
                out += (left.T @ right).astype(np.int64).astype(object) << (LIMB * (a + b))
    return out


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], EXACT)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(number of rows, sums of x) of the most frequent length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            lengths = pc.list_value_length(column)
            for dims in pc.unique(lengths).to_pylist():
                part = column.filter(pc.equal(lengths, dims))
                have = total.setdefault(dims, [0, [0] * dims])
                for x in _whole(part, dims):
                    have[0] += len(x)
                    have[1] = [a + b for a, b in zip(have[1], _added(x))]
        for dims, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), _decimals(s)], names=["dims", "i", "n", "s"])

    each = rows.select("embedding").mapInArrow(run, "dims int, i int, n long, s decimal(38,0)").groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    first = each.where("i = 0").orderBy(F.desc("n"), "dims").first()
    if first is None:
        return 0, []
    return first.n, [int(r.s) for r in each.where(F.col("dims") == first.dims).orderBy("i").collect()]


def covariance(rows: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """Covariance of x, divisor n: exact sums about the rounded means, each entry rounded once."""
    dims, means = len(s), [(2 * v + n) // (2 * n) for v in s]
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, centre = np.zeros((dims, dims), dtype=object), np.array(means, dtype=np.int64)
        for batch in batches:
            for x in _whole(batch.column(0), dims):
                total = total + products(x - centre)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _decimals(total[upper])], names=["i", "j", "v"])

    added = rows.select("embedding").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    left, out = [v - n * m for v, m in zip(s, means)], np.zeros((dims, dims))
    for r in added:
        out[r.i, r.j] = out[r.j, r.i] = (n * int(r.v) - left[r.i] * left[r.j]) / n ** 2
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray          # eigenvalues, falling
    vectors: np.ndarray         # unit vectors, as columns
    explained: list[float]
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as int64 where it and its squares' sum fit, else as whole numbers of any size."""
        means = np.array([(2 * v + self.n) // (2 * self.n) for v in self.sums], dtype=np.int64)
        y, left = x - means, np.array([v - self.n * int(m) for v, m in zip(self.sums, means)], dtype=object)
        top = self.n * (max(int(y.max(initial=0)), -int(y.min(initial=0))) + 1)
        wide = top ** 2 * x.shape[1] >= 1 << 63
        return y.astype(object) * self.n - left if wide else y * self.n - left.astype(np.int64)

    def project(self, deviation: np.ndarray) -> np.ndarray:
        return (deviation / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of all usable rows by at most ``components`` components."""
    rows = usable(vectors)
    n, s = sums(rows)
    if not n:
        return None
    rows = rows.where(F.size("embedding") == len(s))
    matrix = covariance(rows, n, s)
    values, found = leading(matrix, components)
    whole = float(np.trace(matrix))
    good = values > LEAST * whole
    model = Whitening(n, s, values[good], found[:, good], (values[good] / whole).tolist() if whole else [])
    model.identity_error = _error(rows, model)
    return model


def _error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    size, dims = len(model.values), len(model.sums)
    if not size:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))              # the last row: sums
        for batch in batches:
            for x in _whole(batch.column(0), dims):
                w = model.project(model.centred(x))
                total[:-1] += w.T @ w
                total[-1] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.reshape(-1), pa.int32()), pa.array(j.reshape(-1), pa.int32()), pa.array(total.reshape(-1))], names=["i", "j", "v"])

    added = np.zeros((size + 1, size))
    for r in rows.select("embedding").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        added[r.i, r.j] = r.v / model.n
    return float(np.abs(added[:-1] - np.outer(added[-1], added[-1]) - np.eye(size)).max())


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, deviation, whitened): each usable row's exact sum of (n x - S)^2 and its whitened components."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    size, dims = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _whole(batch.column(1), dims):
                deviation = model.centred(x)
                squares = (deviation * deviation).sum(axis=1)
                exact = _decimals(squares) if squares.dtype == object else pa.array(squares).cast(pa.decimal128(19, 0)).cast(EXACT)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(model.project(deviation).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), exact, lists], names=["vec_id", "deviation", "whitened"])
                at += len(x)

    return usable(vectors).where(F.size("embedding") == dims).mapInArrow(run, schema)
