"""Query sets that grow: blocks of queries meeting blocks of the gallery give what one block gives and what plain numpy gives."""

import numpy as np
import pytest

from tessera.operators import vectors as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(300, 6)), 2)
    v[50:60] = v[40:50]  # ties
    rows = [(i, x.tolist(), int(i % 7), i + 1 if i < 299 else 0) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int, expected long").cache(), v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [1000, 64, 37])
def test_topk_and_labels(data, block):
    df, u = data
    q = df.filter("id % 3 = 0").withColumnRenamed("id", "query")
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in V.exact_topk(df, q, 5, exclude_self=True, block=block).collect()}
    s = np.round(u @ u.T, 9)
    want = {}
    for i in range(0, 300, 3):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:5]
        want |= {(i, k + 1): (j, s[i, j]) for k, j in enumerate(order)}
    assert got == want
    best = {(r["query"], r["label"]): r["score"] for r in V.best_per_label(df, df.filter("id % 3 = 0"), "id", "id", "v", "label", exclude_self=True, block=block).collect()}
    assert best == {(i, y): max(s[i, j] for j in range(y, 300, 7) if j != i) for i in range(0, 300, 3) for y in range(7)}


@pytest.mark.parametrize("block", [1000, 64])
def test_summaries_and_expected_ranks(data, block):
    df, u = data
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    got = {r["query"]: (r["above"], r["best"]) for r in V.score_summary(df, df, "id", "v", 0.5, block=block).collect()}
    s5 = np.round(s, 5)
    assert got == {i: ((s5[i] >= 0.5).sum(), s5[i].max()) for i in range(300)}
    asked = df.selectExpr("id as query", "v", "expected").join(df.selectExpr("id as expected", "v as ev", "label as group"), "expected")
    got = {r["query"]: (r["strict"], r["equivalent"]) for r in V.expected_ranks(df, asked, "id", "v", "label", block=block).collect()}
    s9 = np.round(s, 9)
    for i in range(300):
        e = (i + 1) % 300
        ahead = sum(s9[i, j] > s9[i, e] or (s9[i, j] == s9[i, e] and j < e) for j in range(300) if j != i)
        top = max(s9[i, j] for j in range(300) if j != i and j % 7 == e % 7)
        assert got[i] == (ahead + 1, (s9[i] > top).sum() + 1)


def test_empty_sides(spark, data):
    df, _ = data
    q = df.withColumnRenamed("id", "query")
    assert V.exact_topk(df, q.limit(0), 3).count() == 0 and V.exact_topk(df.limit(0), q, 3, block=50).count() == 0
