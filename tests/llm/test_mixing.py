"""Mixing: targets against exact fractions, permutations, whole rounds, the mix's texts, hot sources and edges."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M
from tessera.llm.common import ROW, running_sums

SCHEMA = "doc_id long, text string, source string, s string, size string, words string, block string, before int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "s", "z", "w", "b", 1) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations_are_bijections(n):
    seen = []
    for key in range(3):
        got = M.permuted(np.arange(n), np.full(n, n), np.full(n, 977 * key + 5))
        assert sorted(got) == list(range(n))
        seen.append(tuple(got))
    assert n < 64 or len(set(seen)) == 3


def plain_targets(sizes, weights, most=3):
    total = sum(sizes)
    capped = set()
    while True:
        left = [i for i in range(len(sizes)) if i not in capped]
        rest = Fraction(total - sum(most * sizes[i] for i in capped))
        out = [Fraction(most * sizes[i]) if i in capped else rest * weights[i] / sum(weights[j] for j in left) for i in range(len(sizes))]
        over = {i for i in left if out[i] > most * sizes[i]}
        if not over:
            return out
        capped |= over


def test_targets_equal_exact_fractions():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 30):
        sizes = [int(x) for x in rng.integers(0, 10 ** rng.integers(1, 6, n))]
        weights = [1 + i % 3 for i in range(n)]
        got, want = M.shares(sizes, weights, 3), plain_targets(sizes, weights)
        assert np.allclose(got, [float(w) for w in want], rtol=1e-14) and np.isclose(sum(got), sum(sizes))
    assert M.shares([], [], 3) == []


def test_draws_fill_every_shard_and_follow_the_shares():
    r = M.recipe([10**7, 10**6, 5000, 0, 3], slots=1000)
    drawn = np.array([r.draw(j) for j in range(r.shards)])
    assert (drawn.sum(axis=1) == [r.length(j) for j in range(r.shards)]).all() and drawn.sum() == r.takes.sum()
    assert (np.abs(drawn.sum(axis=0) - r.takes) <= 4 * np.sqrt(np.maximum(r.takes, 1))).all() and len({tuple(x) for x in drawn}) > 5


def words(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))


def corpus(rng):
    rows = [(i, words(rng, int(n)), "hot" if i % 3 == 0 else f"s{i % 7}") for i, n in enumerate(rng.integers(0, 300, 400))]
    rows += [(1000, words(rng, 30_000), "s1"), (1001, None, "s2"), (1002, "", None), (1003, " \t\n", None), (1004, " a b c", None), (None, words(rng, 50), None), (7, words(rng, 40), "s0")]
    return rows + [(2000, "one two three", "tiny")] * 3


def test_taken_words_meet_the_targets_and_agree(spark):
    rows = corpus(np.random.default_rng(8))
    got = M.taken_words(frame(spark, rows), slots=100, block=64).toPandas()
    size = lambda t: len((t or "").encode().split())
    assert Counter((str(i), size(t)) for i, t, _ in rows) == Counter((str(int(i)) if i == i else "None", n) for i, n in zip(got["doc_id"], got["size"]))
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, x in rows if x == s) for s in names]
    want = {n: float(t) for n, t in zip(sizes, plain_targets(sizes, [1 + i % 3 for i in range(len(names))]))}
    assert (got["taken"] <= 3 * got["size"]).all() and len(set(sizes)) == len(sizes)
    for n, g in got.groupby("source_size"):
        assert np.isclose(g["target"], want[n]).all()
        assert abs(g["taken"].sum() - want[n]) <= max(0.01 * want[n], 1)
    again = M.taken_words(frame(spark, rows[::-1]).repartition(7), slots=100, block=64).toPandas()
    key = lambda f: sorted(map(str, f.itertuples(index=False)))
    assert key(got) == key(again)  # whatever the order and the partitions of the rows


def test_mix_holds_the_words_of_its_blocks(spark):
    rows = corpus(np.random.default_rng(9))
    m = M.mixture(frame(spark, rows), words=True, slots=100, block=64)
    mix = m.rows.withColumnRenamed(ROW, "row").toPandas()
    slots = m.slots.toPandas()
    assert len(slots) == m.recipe.takes.sum() == len(slots.drop_duplicates(["shard", "slot"])) and slots.groupby("shard")["slot"].max().iloc[:-1].eq(99).all()
    assert len(slots.drop_duplicates(["s", "round", "block"])) == len(slots) and slots["round"].max() < 3
    by = {(str(i), len((t or "").encode().split())): (t or "").encode().split() for i, t, _ in rows}
    sizes = {r[ROW]: r["size"] for r in m.docs.collect()}
    for r in mix.itertuples(index=False):
        own = by[(str(int(r.doc_id)) if r.doc_id == r.doc_id else "None", sizes[r.row])]
        assert r.words.encode().split() == own[r.word:r.word + r.n_words]
    assert mix.groupby(["s", "round", "block"])["n_words"].sum().max() <= 64


def test_empty_tables_and_texts(spark):
    none = frame(spark, [(1, "a", "x")]).limit(0)
    assert M.taken_words(none).count() == 0
    got = M.taken_words(frame(spark, [(1, None, "x"), (2, "", None)])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    got = M.taken_words(frame(spark, [(1, "a", "x"), (2, "b c", None)])).toPandas()
    assert got["taken"].sum() == 3 and (got["taken"] <= 3 * got["size"]).all()
    with pytest.raises(ValueError):
        M.taken_words(frame(spark, [(1, "a", "x"), (2, "b", "y")]), most_sources=1)


def test_running_sums_across_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).cast("long").alias("g"), (F.col("id") * 7919 % 5000).alias("o"), (F.col("id") % 13).alias("v"))
    got = running_sums(df.repartition(9), "g", ["o"], "v").toPandas().sort_values(["g", "o"])
    assert (got["before"] == got.groupby("g")["v"].cumsum() - got["v"]).all() and len(got) == 5000
