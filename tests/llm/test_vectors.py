"""Operators 11 and 13."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespark.llm import collisions, queries, whitening

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------------------ operator 11

@pytest.mark.parametrize("dims", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["full", "half", "repeated", "nearly equal", "indefinite"])
def test_leading_eigenvalues(dims, kind):
    a = np.random.default_rng(dims).standard_normal((dims, dims))
    matrix = {"full": a @ a.T, "half": a[:, : dims // 2 + 1] @ a[:, : dims // 2 + 1].T, "repeated": np.diag(np.repeat([3.0, 2.0, 1.0], dims)[:dims]),
              "nearly equal": 2 * np.eye(dims) + 1e-13 * (a + a.T), "indefinite": a + a.T}[kind]
    want = np.linalg.eigvalsh(matrix)[::-1]
    for shift in (-0.3, 0.1, 1.5, want[0] + 1):
        assert whitening.above(matrix, shift) == (want > shift).sum()
    values, vectors = whitening.leading(matrix, 9)
    assert np.allclose(values, want[:9], atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-10)


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (9, 1 << 21, 1 << 40, 1 << 61):
        y = rng.integers(-top, top, (700, 3))
        want = y.T.astype(object) @ y.astype(object)
        assert (whitening.products(y) == want).all()


def test_whitening_is_brute_force(spark):
    got = queries.QUERIES["op11_whitening"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.floor(64 * np.array(table.embedding.tolist(), dtype=float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    d = (n * x - total) / n
    v = d.T @ d / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    assert len(got) == 32 * n and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    whitened = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = d @ vectors / np.sqrt(values)
    assert np.allclose(whitened * np.sign((whitened * want).sum(axis=0)), want, atol=1e-8)
    one = got[got.component == 1].sort_values("vec_id")
    assert one.deviation.tolist() == ((n * x - total) ** 2).sum(axis=1).tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, values / np.trace(v), rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(40)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 1.0]), (93, [float("inf"), 1.0, 1.0]), (94, [1.0]), (95, []), (96, [1e30, 0.0, 0.0])]
    rows = [*good, good[3], (None, good[4][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, whitened string")
    model = whitening.fit(frame)
    got = whitening.whiten(frame, model).collect()
    assert model.n == 42 and len(got) == 42 and len(model.values) == 3 and sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in rows)
    far = spark.createDataFrame([(i, [v[0] * 2.0 ** 50, v[1], v[2]]) for i, v in good], "vec_id long, embedding array<double>")
    model = whitening.fit(far)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in (v[0] * 2.0 ** 50, v[1], v[2])] for _, v in good]
    total = [sum(c) for c in zip(*x)]
    want = {i: sum((40 * a - s) ** 2 for a, s in zip(r, total)) for i, r in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(far, model).collect()} == want
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert len(whitening.fit(same).values) == 0 and whitening.whiten(same, whitening.fit(same)).count() == 0
    assert whitening.fit(same.limit(0)) is None and whitening.whiten(same, None).count() == 0


# ------------------------------------------------------------------------------------------ operator 13

def brute_links(rows, least=0.93):
    """(links, component id, kept) of (vec_id, label, vector) rows whose vectors are all usable or None."""
    n, root = len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * n
    units = [None if v is None else np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) for _, _, v in rows]
    for i in range(n):
        for j in range(i):
            if rows[i][1] is not None and rows[i][1] == rows[j][1] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
                if rows[i][2] == rows[j][2] or units[i] @ units[j] >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        least_id = min(ids) if ids else None
        out.append((rows[i][0], links[i], least_id, rows[i][0] is not None and rows[i][0] == least_id))
    return sorted(out, key=repr)


def near_rows(seed, n, dims=24):
    """Groups around centres, some pairs near the threshold, a third of all rows around one centre."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dims))
    rows = []
    for i in range(n):
        centre = centres[0 if i % 3 == 0 else int(rng.integers(len(centres)))]
        rows.append((i, int(rng.integers(3)) if i % 3 else 1, (centre + rng.uniform(0, 0.45) * rng.standard_normal(dims)).astype("float32").tolist()))
    return rows


def test_links_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 50)
    rows = near_rows(13, 420)
    rows += [(1000 + i, 1, rows[0][2]) for i in range(60)] + [rows[4], (None, 1, rows[0][2]), (None, 2, [9.0] * 24), (2000, 7, [1.0, 2.0]), (2001, 7, [1.0, 2.0, 0.0]), (2002, 7, [2.0, 4.0])]
    odd = [(3000, 1, None), (3001, 1, [0.0] * 24), (3002, 1, [float("nan")] + [1.0] * 23), (3003, 1, [None] + [1.0] * 23), (3004, 1, [float("inf")] * 24), (3005, 1, []), (3006, None, rows[0][2]), (None, None, None)]
    frame = spark.createDataFrame([(i, label, v, "x", 5) for i, label, v in rows + odd], "vec_id long, label int, embedding array<float>, node string, id int")
    got = sorted(map(tuple, collisions.link(frame).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    want = sorted(brute_links(rows) + [(i, 0, i, i is not None) for i, _, _ in odd], key=repr)
    assert got == want
    assert collisions.link(frame.limit(0)).count() == 0


def test_links_of_doubles_and_queries(spark):
    rows = [(1, "a", [1e200, 1e200]), (2, "a", [1e-200, 1e-200]), (3, "a", [1.0, -1.0]), (4, "b", [1.0, 1.0]), (5, "a", [0.0, 1.0]), (6, "a", [-0.0, 1.0])]
    got = sorted(map(tuple, collisions.link(spark.createDataFrame(rows, "vec_id int, label string, embedding array<double>")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)]
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_links([(r.vec_id, r.label, list(r.embedding)) for r in table.collect()])
    assert sorted(map(tuple, queries.QUERIES["op13_vector_links"](spark, SF).collect()), key=repr) == want


def test_count_is_calibrated():
    count, rng = collisions.calibrated(miss=0.01), np.random.default_rng(2)
    a = collisions.unit(rng.standard_normal((6000, 64)))
    side = collisions.unit(rng.standard_normal((6000, 64)))
    side = collisions.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * side                # exactly at the threshold
    hits = (np.abs((a - b) @ collisions.directions(64)) <= collisions.window()).sum(axis=1)
    assert 0.97 < (hits >= count).mean() and (hits >= collisions.calibrated()).all()
    far = (np.abs((a[:3000] - a[3000:]) @ collisions.directions(64)) <= collisions.window()).sum(axis=1)
    assert (far >= collisions.calibrated()).mean() < 0.01


def test_far_blocks_do_not_meet(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16))
    rows = [(k, "a", (centres[k % 40] + 0.01 * rng.standard_normal(16)).tolist()) for k in range(800)]
    nodes = collisions._nodes(collisions._rows(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))).withColumn("copies", F.lit(1).cast("long"))
    blocks = collisions._blocks(nodes, 1)
    single = blocks.count()
    assert single == 1
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collisions, "BLOCK", 20)
        blocks = collisions._blocks(nodes, 1).withColumn("id", F.monotonically_increasing_id()).cache()
        met = collisions._meetings(blocks, collisions.calibrated(), collisions.window()).count()
    n = blocks.count()
    assert n == 40 and met < 0.6 * n * (n + 1) / 2
