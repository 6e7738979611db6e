"""The stateful streams against their batch twins and plain loops: rows out of order, several micro-batches, locks, rejections and expiries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import state as S

T0 = dt.datetime(2024, 1, 1)
FAR = T0 + dt.timedelta(days=40)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, schema, files, make):
    """The rows of the stream over ``files`` (each a micro-batch), with a last row that drives the watermark past all others."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return [tuple(r) for r in spark.read.parquet(out).collect() if r[0] != 99]


def batches(rows, n, far):
    """Dealt into n micro-batches by time, each in a random order, neighbours swapped across their borders; then a far row."""
    rows = sorted(rows, key=lambda r: r[1])
    r, size = random.Random(7), -(-len(rows) // n)
    files = [rows[i:i + size] for i in range(0, len(rows), size)]
    for a, b in zip(files, files[1:]):
        a[-1], b[0] = b[0], a[-1]
    for f in files:
        r.shuffle(f)
    return [*files, [far]]


def key(rows):
    return sorted(rows, key=str)


def test_stability(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, at(i * 400 + r.randint(0, 150)), k * 1000 + i, r.sample(["a", "b", "c"], r.randint(2, 3)) if i % 7 else []) for k in range(3) for i in range(60)]
    rows += [(1, rows[70][1], 5000, ["a", "b"])]  # two frames at one time
    schema = "k long, ts timestamp, id long, tokens array<string>"
    got = run(spark, tmp_path, schema, batches(rows, 4, (99, FAR, 0, [])), lambda s: S.stability_stream(s, "k", "ts", "id", "tokens", "5 seconds"))
    want = []
    for k, t, i, tokens in rows:
        near = [x for q, u, _, x in rows if q == k and t - dt.timedelta(milliseconds=2600) <= u <= t]
        mean = sum(S.token_overlap(tokens, x) for x in near) / len(near)
        want.append((k, i, len(near), round(mean, 9), len(near) >= 3 and round(mean, 9) >= 0.72))
    assert key(got) == key(want) and {w[-1] for w in want} == {True, False}
    twin = S.stability_table(spark.createDataFrame(rows, schema), "k", "ts", "id", "tokens")
    assert key(map(tuple, twin.collect())) == key(want)


def test_still(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, at(i * 300 + r.randint(0, 90)), k * 1000 + i, r.choice([0.5, 0.55, 0.6, 0.9]), 0.3, r.choice([0.1, 0.15])) for k in range(3) for i in range(50)]
    schema = "k long, ts timestamp, id long, a double, b double, c double"
    names = ["a", "b", "c"]
    got = run(spark, tmp_path, schema, batches(rows, 3, (99, FAR, 0, 0.0, 0.0, 0.0)), lambda s: S.still_stream(s, "k", "ts", "id", names, "5 seconds"))
    want, last = [], {}
    for k, t, i, *m in sorted(rows, key=lambda x: x[:3]):
        before, still = last.get(k), 0.0
        if before and round(sum(abs(x - y) for x, y in zip(before[1], m)), 9) < 0.18:
            still = before[2] + (t - before[0]) / dt.timedelta(milliseconds=1)
        last[k] = (t, m, still)
        want.append((k, i, pytest.approx(still), pytest.approx(min(1, still / 900))))
    by = lambda rs: sorted(rs, key=lambda x: x[:2])
    assert by(got) == by(want) and by(map(tuple, S.still_table(spark.createDataFrame(rows, schema), "k", "ts", "id", names).collect())) == by(want)
    assert max(g[3] for g in got) == 1.0


def test_period_locks_once_and_rejects(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, at(500 * k + i * 210), k * 1000 + i, float(r.randint(0, 99)) if i % 5 else None) for k in range(4) for i in range(25)] + [(7, at(10), 7000, 3.0)]
    schema = "k long, ts timestamp, id long, v double"
    got = run(spark, tmp_path, schema, batches(rows, 5, (99, FAR, 0, 0.0)), lambda s: S.period_stream(s, "k", "ts", "id", "v", "3 seconds"))
    locked = {g[0]: g for g in got if g[1] == "locked"}
    assert len(locked) == sum(g[1] == "locked" for g in got) == 5
    for k, g in locked.items():
        first = min(t for q, t, _, _ in rows if q == k)
        inside = [v for q, t, _, v in rows if q == k and t < first + dt.timedelta(seconds=2)]
        assert g[3:] == (first + dt.timedelta(seconds=2), len(inside), max(v for v in inside if v is not None))
    assert sorted(g[2] for g in got if g[1] == "rejected") == sorted(i for q, t, i, _ in rows if t >= min(u for p, u, _, _ in rows if p == q) + dt.timedelta(seconds=2))
    assert key(map(tuple, S.period_table(spark.createDataFrame(rows, schema), "k", "ts", "id", "v").collect())) == key(got)


def test_leases(spark, tmp_path):
    beats = {1: [0, 900, 1800], 2: [0, 3000, 6000, 9000, 12_000], 3: [0, 500, 4000], 4: [0, 3000], 5: [0, 1000, 2000, 3000, 5001]}
    stops = {(3, 500), (4, 3000)}
    rows = [(k, at(ms), k * 1000 + i, (k, ms) in stops or None) for k, own in beats.items() for i, ms in enumerate(own)]
    schema = "k long, ts timestamp, id long, stop boolean"
    got = run(spark, tmp_path, schema, batches(rows, 4, (99, FAR, 0, False)), lambda s: S.lease_stream(s, "k", "ts", "id", "stop", "4 seconds", 2000))
    want = [(1, at(3800), 1, "queued"), (2, at(2000), 1, "queued"), (2, at(5000), 2, "queued"), (2, at(8000), 3, "failed"), (3, at(2500), 1, "cancelled"),
            (4, at(2000), 1, "queued"), (4, at(5000), 2, "cancelled"), (5, at(5000), 1, "queued"), (5, at(7001), 2, "queued")]
    assert key(got) == key(want)
    twin = S.lease_table(spark.createDataFrame(rows, schema), "k", "ts", "id", "stop", 2000, F.lit(FAR))
    assert key(map(tuple, twin.collect())) == key(want)
