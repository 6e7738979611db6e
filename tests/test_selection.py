"""Resampling, nested selection, weight grids and forbidden pairs against plain versions."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.operators import datasets as D
from tessera.operators import evaluate as E


def test_resamples_are_whole_and_follow_the_law(spark, monkeypatch):
    rng = np.random.default_rng(1)
    groups = {"few": rng.integers(-1, 2, 300).astype(float), "many": np.round(rng.normal(0.3, 1, 2000), 4), "one": np.array([2.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("few", None)], "g string, x double")
    monkeypatch.setattr(E, "_VALUES", 100)  # "many" is drawn in about twenty buckets
    got = E.resample_means(df, "g", "x", 600, 5).toPandas()
    assert got.groupby("g")["b"].nunique().to_dict() == {"few": 600, "many": 600, "one": 600}
    for g, own in got.groupby("g"):
        assert (own["n"] == len(groups[g])).all()
        plain = groups[g][rng.integers(0, len(groups[g]), (600, len(groups[g])))].mean(axis=1)
        assert own["mean"].mean() == pytest.approx(groups[g].mean(), abs=5 * plain.std() / 600**0.5 + 1e-12)
        assert own["mean"].std() == pytest.approx(plain.std(), rel=0.2, abs=1e-12)
    again = E.resample_means(df.repartition(7), "g", "x", 600, 5).toPandas()
    key = lambda f: sorted(f.round(9).itertuples(index=False))
    assert key(got) == key(again)
    assert E.resample_means(df.limit(0), "g", "x", 10).count() == 0


def test_interval_covers_a_plain_bootstrap(spark):
    rng = np.random.default_rng(2)
    groups = {g: rng.choice([-1.0, 0, 1], 80, p=[0.2, 0.5, 0.3]) for g in "abc"}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, x double")
    r = E.bootstrap_delta(df, "g", "x", 4000, 3).first()
    plain = np.mean([v[rng.integers(0, 80, (4000, 80))].mean(axis=1) for v in groups.values()], axis=0)
    assert np.allclose([r["low"], r["mid"], r["high"]], np.quantile(plain, [0.025, 0.5, 0.975]), atol=0.02)


def plain_nested(rows, factors):
    names = sorted({d for d, _, _ in rows})

    def right(config, fit, judged):
        own = [v for d, v, _ in rows if d in fit]
        cut = round(factors[config] * sum(own) / len(own), 6)
        return sum((v > cut) == t for d, v, t in rows if d == judged)

    n, out = {s: sum(d == s for d, _, _ in rows) for s in names}, set()
    for outer in names:
        rest = [s for s in names if s != outer]
        table = [(round(np.mean([right(c, [s for s in rest if s != j], j) / n[j] for j in rest]), 9), sum(right(c, [s for s in rest if s != j], j) for j in rest), -c) for c in range(len(factors))]
        macro, _, c = max(table)
        out.add((outer, -c, macro, n[outer], right(-c, rest, outer)))
    return out


def test_nested_selection(spark):
    rng = np.random.default_rng(4)
    rows = [(f"d{i % 4}", float(rng.integers(1, 100) * (1 + i % 4)), bool(rng.random() < 0.5)) for i in range(400)]
    df = spark.createDataFrame([*rows, ("d0", None, True), ("d0", 3.0, None)], "dataset string, v double, t boolean").filter("v is not null and t is not null")
    factors = (0.2, 0.6, 1.0, 1.4)
    got = {(r["dataset"], r["config"], r["inner_macro"], r["n"], r["ok"]) for r in E.nested_selection(df, "dataset", "v", "t", factors).collect()}
    assert got == plain_nested(rows, factors)


def test_weight_grid_and_constraints(spark):
    rng = np.random.default_rng(5)
    rows = [(q, q % 3, c, bool(rng.random() < 0.3), bool(rng.random() < 0.3), *[float(x) for x in rng.integers(0, 5, 3)]) for q in range(120) for c in range(6)]
    df = spark.createDataFrame(rows, "query long, dataset long, cid long, truth boolean, sibling boolean, a double, b double, c double")
    grid = E.weight_grid({"a": (0.0, 1.0), "b": (0.0, 0.5), "c": (-0.5, 0.25, 1.0)})
    assert len(grid) == 12 and grid[1] == {"a": 0.0, "b": 0.0, "c": 0.25}
    got = E.weight_grid_metrics(df, grid, df["a"])
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
    pick = lambda q, w: max(own[q], key=lambda r: (round(w["a"] * r[5] + w["b"] * r[6] + w["c"] * r[7], 9), -r[2]))
    base, table = {q: pick(q, {"a": 1, "b": 0, "c": 0}) for q in own}, defaultdict(lambda: [0] * 6)
    for i, w in enumerate(grid):
        for q in own:
            p, z, m = pick(q, w), base[q], table[i, q % 3]
            for k, x in enumerate((True, p[3], z[3] and not p[3], p[4] and not p[3], z[3], z[4] and not z[3])):
                m[k] += x
    assert {(r["config"], r["dataset"]): list(r)[2:] for r in got.collect()} == dict(table)

    def feasible(i):
        d = [table[i, s] for s in range(3)]
        return sum(x[2] for x in d) <= 0.2 * sum(x[0] for x in d) and d[1][1] >= d[1][4] - 2 and sum(x[3] for x in d) <= sum(x[5] for x in d)

    order = lambda i: (feasible(i), round(np.mean([table[i, s][1] / table[i, s][0] for s in range(3)]), 9), sum(table[i, s][1] for s in range(3)), -sum(table[i, s][2] for s in range(3)), -i)
    best = E.select_weights(got, {1: 2}).first()
    assert best["config"] == max(range(12), key=order) and best["feasible"] == feasible(best["config"])
    assert {feasible(i) for i in range(12)} == {True, False}


def test_forbidden_pairs_in_two_levels(spark):
    rows = [(1, "x"), (2, "x"), (3, "x"), (4, None), (5, None), (6, "y"), (7, "z"), (7, "z")]
    curated = [("s", "series", 3), ("s", "series", 6), ("d", "diagnostic", 6), ("d", "diagnostic", 7), ("d", "diagnostic", 7), ("lone", "series", 5), ("gone", "series", 99), ("gone", "series", 1)]
    df, groups = spark.createDataFrame(rows, "id long, h string"), spark.createDataFrame(curated, "group string, reason string, key long")
    m = D.forbidden_membership(df, "id", "h", groups, ["diagnostic"])
    assert {(r["group"], r["key"]) for r in m.collect()} == {("x", 1), ("x", 2), ("x", 3), ("s", 3), ("s", 6), ("d", 6), ("d", 7)}
    pairs = [(a, b) for a in range(1, 8) for b in range(1, 8)]
    hard = {p: {"identical_content"} for p in combinations([1, 2, 3], 2)} | {(3, 6): {"series"}, (6, 7): {"diagnostic"}}
    got = {(r["a"], r["b"]): (set(r["reasons"]), r["negative"], r["hard_negative"]) for r in D.pair_verdicts(spark.createDataFrame(pairs * 2, "a long, b long"), m, "a", "b").collect()}
    for a, b in pairs:
        why = hard.get((min(a, b), max(a, b)), set())
        assert got[a, b] == (why, a != b and not why - {"diagnostic"}, a != b and not why)


def test_model_states_equal_a_fold(spark):
    """Random requests in random order against the state machine folded one request at a time; a task never has two promoted models."""
    rng = np.random.default_rng(9)
    models = [(m, f"t{m % 3}") for m in range(30)]
    checks = [(m, s) for m in range(30) for s in (["validation", "test"] if m % 4 else ["test"])]
    moves = ["validated", "promoted", "deprecated"]
    requests = [(int(rng.integers(0, 32)), moves[int(rng.choice(3, p=[0.4, 0.45, 0.15]))], int(rng.integers(0, 60)), n) for n in range(220)]
    status, promoted, rejected = dict.fromkeys(range(30), "candidate"), {}, defaultdict(int)
    fits = {"candidate": ("validated", "deprecated"), "validated": ("promoted", "deprecated"), "promoted": ("deprecated",), "deprecated": ()}
    for m, to, at, _ in sorted(requests, key=lambda r: (r[2], r[3])):
        if m not in status:
            continue
        if to not in fits[status[m]] or (to != "deprecated" and (m, "validation") not in checks):
            rejected[m] += 1
            continue
        if to == "promoted":
            for other in status:
                if other != m and other % 3 == m % 3 and status[other] == "promoted":
                    status[other] = "deprecated"
            promoted[m] = at
        status[m] = to
    got = D.model_states(spark.createDataFrame(models, "model long, task string"), spark.createDataFrame(checks, "model long, split string"),
                         spark.createDataFrame(requests, "model long, to string, at long, n long")).collect()
    assert {r["model"]: (r["status"], r["promoted_at"], r["rejected"]) for r in got} == {m: (status[m], promoted.get(m), rejected[m]) for m in range(30)}
    assert len(set(status.values())) >= 3
    tasks = [r["task"] for r in got if r["status"] == "promoted"]
    assert tasks and len(tasks) == len(set(tasks))


def test_full_scoring_in_blocks(spark):
    from tessera.functions import text as T
    from tessera.operators import lexical as L
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcd"), int(rng.integers(1, 6))))
    left, right = spark.createDataFrame([(word() + str(i % 3),) for i in range(40)], "a string").distinct(), spark.createDataFrame([(word() + str(i),) for i in range(90)], "b string").distinct()
    want = sorted(map(tuple, L.score_all(left, right, T.edit_similarity("a", "b"), ["a"], ["b"], 4).collect()))
    assert sorted(map(tuple, L.score_all(left, right, T.edit_similarity("a", "b"), ["a"], ["b"], 4, most=13).select("a", "b", "score").collect())) == want and len(want) == 4 * left.count()
