"""Recall of the forest on isotropic pairs, links against brute force, and edge cases."""

import numpy as np
import pytest

from tessera.llm import embedding_dedup as E


@pytest.mark.parametrize("depth", [4, 8, 12])
def test_recall_of_the_forest_at_the_threshold(depth):
    rng = np.random.default_rng(41)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.standard_normal(a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * r
    noise = rng.standard_normal((20_000, 64))
    forest = E.fit_forest(noise / np.linalg.norm(noise, axis=1, keepdims=True), 8, min(depth, 11), 7, 0.015)
    met, copies = np.zeros(len(a), bool), 0
    for t, cuts in enumerate(forest):
        (ra, na), (rb, nb) = E._leaves(a, cuts, t, depth, 7, 0.015), E._leaves(b, cuts, t, depth, 7, 0.015)
        copies += len(ra) / len(a)
        met[[i for i, _ in set(zip(ra, na)) & set(zip(rb, nb))]] = True
    assert met.mean() > 0.985 and copies < 30


def test_links_equal_brute_force_with_text_labels_and_lengths(spark):
    rng = np.random.default_rng(42)
    rows = []
    for dim, label, n in ((16, "a", 250), (16, "b", 250), (8, "a", 100)):
        base = rng.standard_normal((n // 5, dim))
        for j in range(n):
            rows.append((len(rows), [float(x) for x in base[j % len(base)] + 0.12 * (j >= len(base)) * rng.standard_normal(dim)], label))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, k string, links int")
    got = {r["vec_id"]: r for r in E.embedding_components(df, leaf=32, block=16).collect()}
    want = np.zeros(len(rows), int)
    for i, (_, u, lu) in enumerate(rows):
        for j, (_, v, lv) in enumerate(rows):
            want[i] += i != j and lu == lv and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum() > 500
    assert E.embedding_components(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(5, v, 1), (5, v, 1), (None, v, 1), (3, [2.0, 4.0, 6.0], 1), (9, v, 2)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in E.embedding_components(df).collect()))
    assert got == [(-1, 3, 3, False), (3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False), (9, 0, 9, True)]
