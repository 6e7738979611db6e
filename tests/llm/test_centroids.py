"""Centroid clustering and whitening against plain versions in Python integers and numpy's eigenvectors."""

import hashlib
import math

import numpy as np
import pytest

from tessera.llm import centroids as C
from tessera.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int, x string, cluster string, n int, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c", 1, "w") for i, v in rows], SCHEMA)


def plain_clusters(rows, k=8, rounds=10, dim=64):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) for c in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, hashlib.sha256(f"3:{rows[r][0]}".encode()).hexdigest(), x[r]))
    c = [list(x[r]) for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, y)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for v in x]
        for j in range(len(c)):
            mine = [x[r] for r in range(len(x)) if own[r] == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [nearest(v) for v in x]
    by = [sum(d for d, j in found if j == m) for m in range(len(c))]
    return sorted((str(rows[r][0]), j, d, by[j], sum(by), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for r, (d, j) in enumerate(found))


def test_clusters_equal_the_plain_version(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 64))
    rows = [(i, (base[i % 6] + 0.3 * rng.normal(size=64)).tolist()) for i in range(240)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (900, rows[9][1]), (901, [0.0] * 64), (902, [-0.0] * 64), (903, None), (904, []), (905, [1.0] * 63),
             (906, [None] + [1.0] * 63), (907, [float("nan")] + [1.0] * 63), (908, [float("-inf")] + [1.0] * 63)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]  # a third are copies
    got = sorted((str(r[0]), *r[1:]) for r in C.centroid_clusters(frame(spark, rows)).collect())
    assert got == plain_clusters(rows)
    small = [(1, [0.5] * 64), (2, [0.25] * 64), (3, [0.5] * 64)]  # fewer than eight, and a tie
    assert sorted((str(r[0]), *r[1:]) for r in C.centroid_clusters(frame(spark, small)).collect()) == plain_clusters(small)
    assert C.centroid_clusters(frame(spark, small).limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 1000, 10**15])
def test_search_finds_the_nearest_and_passes_over_many(scale):
    rng = np.random.default_rng(2)
    c = (rng.normal(size=(200, 16)) * 40 * np.linspace(0.2, 3, 200)[:, None] + rng.normal(size=(200, 1)) * 60).astype(np.int64) * scale
    x = (c[rng.integers(0, 200, 500)] // scale + rng.integers(-9, 9, (500, 16))) * scale
    x[:50] = c[:50]
    c[60] = c[10]  # ties go to the smaller number
    number, d, computed = C.Codebook(c).nearest(x)
    for i in range(len(x)):
        best = min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], y)), j) for j, y in enumerate(c))
        assert (int(d[i]), number[i]) == best
    assert computed < 0.25 * 200 * len(x)


def test_counts_are_the_inertia():
    rng = np.random.default_rng(3)
    for v in (rng.normal(size=(20, 20)), np.zeros((5, 5)), np.diag([1.0, 1, 1, -2, 0]), np.array([[0, 1.0], [1, 0]])):
        v = v + v.T
        e = np.linalg.eigvalsh(v)
        for s in (-3.1, -0.7, 0.1, 0.9, 2.3):
            assert W.above(v, s) == (e > s).sum()


@pytest.mark.parametrize("spectrum", ["far", "near", "equal", "deficient"])
def test_leading_eigenvectors(spectrum):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    e = {"far": 2.0 ** -np.arange(40), "near": 1 + 1e-9 * np.arange(40)[::-1], "equal": np.repeat([5.0, 3.0, 1.0, 0.5], 10), "deficient": np.r_[3.0, 2, 1, np.zeros(37)]}[spectrum]
    v = q @ np.diag(e) @ q.T
    v = (v + v.T) / 2
    values, vectors = W.leading(v, 16, least=1e-13 * np.trace(v))
    assert np.allclose(values, e[:16][e[:16] > 0], rtol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.abs(v @ vectors.T - vectors.T * values).max() < 1e-13 * e[0] * 40


def plain_whitening(rows, k=16):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    fit = [list(t) for t in dict.fromkeys(map(tuple, x))]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    f = np.array([[n * a - b for a, b in zip(v, s)] for v in fit], object)
    cov = np.array(f.T @ f / n**3, float)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for (i, _), v in zip(rows, x):
        d = [n * a - b for a, b in zip(v, s)]
        w = np.array(d, float) / n @ u / np.sqrt(e)
        out.append((i, n, sum(t * t for t in d), w, e / np.trace(cov)))
    return out


def test_whitening_equals_the_plain_version(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(24, 24)) * np.linspace(0.3, 2, 24)
    rows = [(i, (rng.normal(size=24) @ m).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(3, rows[3][1]), (None, rows[4][1])]
    bad = [(7, None), (8, []), (9, [None] * 24), (10, [float("inf")] * 24), (11, [float("nan")] * 24)]
    got = W.whiten(frame(spark, rows + bad)).toPandas()
    assert len(got) == 16 * len(rows) and got["identity_error"].nunique() == 1 and 0 <= got["identity_error"].iloc[0] < 1e-9
    sign = None
    mine = {str(i): g.sort_values("component") for i, g in got.drop_duplicates(["vec_id", "component"]).assign(vec_id=lambda f: f["vec_id"].astype("Int64").astype(str)).groupby("vec_id")}
    for i, n, deviation, w, explained in plain_whitening(rows):
        g = mine["<NA>" if i is None else str(i)]
        sign = np.sign(w * g["whitened"]).to_numpy() if sign is None else sign
        assert (g["n"] == n).all() and (g["deviation"] == deviation).all()
        assert np.allclose(g["whitened"], w * sign, atol=1e-9) and np.allclose(g["explained"], explained, rtol=1e-10)


def test_lengths_and_lists_without_variance(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(30)] + [(200 + i, [1.0] * 7) for i in range(3)]
    got = W.whiten(frame(spark, rows)).toPandas()
    assert got.groupby("n").size().to_dict() == {40: 200, 30: 90}  # the seven-entry vectors are one, without variance
    assert got["identity_error"].max() < 1e-9
    assert W.whiten(frame(spark, rows).limit(0)).count() == W.whiten(frame(spark, [(1, [2.0, 3.0])])).count() == 0
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)]  # one direction only
    got = W.whiten(frame(spark, flat)).toPandas()
    assert set(got["component"]) == {1} and np.isclose(got["explained"], 1).all()
    huge = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(9)]
    assert W.whiten(frame(spark, huge)).count() == 9  # beside the first entry the second has no share that doubles can show
