"""Operators without oracle SQL against plain Python, and invariants: order, partitioning, repetition, streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import datasets, evaluate, expect, fusion, graph, merge, regions, relational, vectors
from tessera.plans import registry
from tessera.streaming import sessions
from tests.conftest import DATA


def test_components_any_shape(spark):
    random.seed(1)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _suppress(boxes, most):
    out = []
    for b in sorted(boxes, key=lambda r: (-r[6], r[1])):
        def iou(a, c):
            w = max(0, min(a[2] + a[4], c[2] + c[4]) - max(a[2], c[2]))
            h = max(0, min(a[3] + a[5], c[3] + c[5]) - max(a[3], c[3]))
            return w * h / (a[4] * a[5] + c[4] * c[5] - w * h)
        if all(iou(b, k) <= most for k in out):
            out.append(b)
    return {b[1] for b in out}


def test_suppression(spark):
    random.seed(2)
    boxes = [(i % 3, i, random.random() * 20, random.random() * 20, 5 + random.random() * 5, 5 + random.random() * 5, round(random.random(), 3)) for i in range(90)]
    df = spark.createDataFrame(boxes, "image long, box_id long, x double, y double, width double, height double, score double")
    got = {r["box_id"] for r in regions.suppress(df, 0.3).collect()}
    assert got == set().union(*(_suppress([b for b in boxes if b[0] == i], 0.3) for i in range(3)))


def test_consensus_equals_a_plain_loop(spark):
    random.seed(3)
    rows = [(i % 2, random.choice("ab"), random.random() * 12, random.random() * 12, 4 + random.random() * 3, 4 + random.random() * 3, round(random.random(), 4)) for i in range(80)]

    def iou(a, c):
        w = max(0, min(a[2] + a[4], c[2] + c[4]) - max(a[2], c[2])) * max(0, min(a[3] + a[5], c[3] + c[5]) - max(a[3], c[3]))
        return w / (a[4] * a[5] + c[4] * c[5] - w)
    want = []
    for image in (0, 1):
        for text in "ab":
            left = sorted((r for r in rows if r[:2] == (image, text)), key=lambda r: (-r[6], r[2], r[3]))
            while left:
                mine = [r for r in left if r is left[0] or iou(left[0], r) >= 0.5]
                left = [r for r in left if r not in mine]
                total = sum(r[6] for r in mine)
                want.append((image, text, round(sum(r[2] * r[6] for r in mine) / total, 6), len(mine), round(total / len(mine), 6)))
    df = spark.createDataFrame(rows, "image long, text string, x double, y double, width double, height double, score double")
    got = [(r["image"], r["text"], round(r["x"], 6), r["support"], round(r["score"], 6)) for r in regions.consensus(df).collect()]
    assert sorted(got) == sorted(want)


def test_consensus_counts_every_region_once(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.0, 4.0, 4.0, 0.9), (1, "a", 0.1, 0.0, 4.0, 4.0, 0.8), (1, "a", 9.0, 9.0, 2.0, 2.0, 0.5), (1, "b", 0.0, 0.0, 4.0, 4.0, 0.7)],
                               "image long, text string, x double, y double, width double, height double, score double")
    got = regions.consensus(df).toPandas()
    assert sorted(got["support"]) == [1, 1, 2] and got["support"].sum() == 4


def test_merge_is_idempotent_and_guarded(spark):
    base = spark.createDataFrame([(1, "a", False), (2, None, True)], "k long, v string, f boolean")
    delta = spark.createDataFrame([(2, "b", False), (3, "c", True)], "k long, v string, f boolean")
    once = merge.merge_upsert(base, delta, ["k"], ["v"], any_of=["f"])
    twice = merge.merge_upsert(once, delta, ["k"], ["v"], any_of=["f"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", False), (2, "b", True), (3, "c", True)]
    plan = spark.createDataFrame([(1, "a", "z")], "k long, expected string, replacement string")
    done = merge.apply_guarded(base, plan, "k", "v")
    assert {r["k"]: r["v"] for r in done.collect()} == {1: "z", 2: None}
    with pytest.raises(ValueError):
        merge.apply_guarded(base, spark.createDataFrame([(1, "q", "z")], plan.schema), "k", "v")
    assert sorted(r["k"] for r in merge.insert_absent(base, delta, ["k"]).collect()) == [1, 2, 3]


def test_topk_any_partitioning(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    q = e.filter("vec_id % 50 = 0")
    a = [tuple(r) for r in vectors.exact_topk(e.repartition(1), q, 5, "vec_id", "vec_id", "embedding").orderBy("query", "rank").collect()]
    b = [tuple(r) for r in vectors.exact_topk(e.repartition(7), q, 5, "vec_id", "vec_id", "embedding").orderBy("query", "rank").collect()]
    assert [x[:2] for x in a] == [x[:2] for x in b] and len(a) == 5 * q.count()


def test_phash_pairs(spark):
    random.seed(3)
    base = [random.getrandbits(63) for _ in range(20)]
    hs = base + [h ^ (1 << random.randint(0, 62)) ^ (1 << random.randint(0, 62)) for h in base]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if hs[i] != hs[j] and bin(hs[i] ^ hs[j]).count("1") <= 6}
    got = {tuple(r) for r in vectors.phash_near(spark.createDataFrame(list(enumerate(hs)), "k long, h long"), "k", "h").collect()}
    assert got == want


def test_match_scores_do_not_depend_on_order(spark):
    a = registry.QUERIES["m1_match_products"](spark, DATA).toPandas().sort_values(["l", "rank"]).reset_index(drop=True)
    assert a["score"].between(0.3, 1).all() and (a.groupby("l")["score"].diff().dropna() <= 0).all()
    pd.testing.assert_frame_equal(a, registry.QUERIES["m1_match_products"](spark, DATA).toPandas().sort_values(["l", "rank"]).reset_index(drop=True))


def test_bootstrap_interval(spark):
    r = registry.QUERIES["d36_bootstrap"](spark, DATA).first()
    assert r["low"] <= r["mid"] <= r["high"] and -1 <= r["low"] and r["high"] <= 1


def test_negative_sample_is_stable(spark):
    c = spark.range(200).selectExpr("id % 5 as a", "id as c")
    one = sorted(map(tuple, datasets.negative_sample(c, "a", "c", 3, 1).collect()))
    assert one == sorted(map(tuple, datasets.negative_sample(c.repartition(7), "a", "c", 3, 1).collect())) and len(one) == 15


def test_flow_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").filter("user_id < 10")
    batch = {r["user_id"]: tuple(r)[1:] for r in sessions.flow_batch(e, "user_id", "ts", "event_type", "value").collect()}
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    q = (sessions.flow_stream(spark.readStream.schema(e.schema).parquet(src), "user_id", "ts", "event_type", "value")
         .writeStream.format("memory").queryName("flow").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start())
    q.awaitTermination(120)
    got = {r["user_id"]: tuple(r)[1:] for r in spark.table("flow").collect()}
    assert got == batch


def test_evidence_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    src = str(tmp_path / "in")
    e.write.parquet(src)
    q = (sessions.token_evidence(spark.readStream.schema(e.schema).parquet(src), "user_id", "event_type", "value")
         .writeStream.format("memory").queryName("evidence").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start())
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("evidence").collect())) == sorted(map(tuple, sessions.token_evidence(e, "user_id", "event_type", "value").collect()))


def test_small_things(spark):
    assert expect.check(a=spark.range(3), b=spark.range(0)).count() == 2
    r = spark.createDataFrame([("q", "s", 1, 5.0, 1), ("q", "s", 2, 5.0, 2)], "query string, source string, cid long, score double, rank int")
    assert {x["scaled"] for x in fusion.minmax(r).collect()} == {1.0}
    assert evaluate.rank_metrics(spark.createDataFrame([(1,), (None,)], "rank int")).first()["mrr"] == 0.5
    p = spark.range(10)
    assert relational.fingerprint(p.repartition(3)).first() == relational.fingerprint(p.repartition(1)).first()
    assert p.select(F.count("*")).first()[0] == 10
