"""Stateful operators of a frame stream: each as a processor with event-time timers and as a query over a finished table.

A processor takes the rows of a key in event-time order, whatever the order they arrive in: a row waits in list state until the
watermark has passed it, a timer then takes it out.  So a stream gives the rows of its batch twin (for all rows that are not later than the
watermark allows, up to the last watermark), however the input falls into micro-batches.  State of a key holds the rows that wait and those
that later rows still look back to, no more.

Streams need ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider (``ROCKSDB``).
Times count in microseconds.  Rows of equal time are taken in the order of their id.  Null keys are a key of their own, rows with a null time
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Feeds ``step`` with rows (t, id, done, payload) in order once the watermark has passed them."""

    payload: str
    carried: str
    result: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("rows", f"t long, id long, done boolean, payload {self.payload}")
        self._carry = handle.getValueState("carry", self.carried)

    def step(self, carry: tuple | None, past: list[tuple], ready: list[tuple], now: int) -> tuple[list[tuple], tuple | None, list[tuple], int | None]:
        """(result rows, what is carried on, rows to keep, a time to be called at again) from what was carried and kept and the rows that are due."""
        raise NotImplementedError

    def _advance(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        now = watermark * 1000
        past, waiting = [r for r in rows if r[2]], [r for r in rows if not r[2]]
        ready = sorted((r for r in waiting if r[0] <= now), key=lambda r: r[:2])
        waiting = [r for r in waiting if r[0] > now]
        out, carry, keep, wake = self.step(tuple(self._carry.get()) if self._carry.exists() else None, past, ready, now)
        kept = [(t, i, True, p) for t, i, _, p in keep] + waiting
        if kept:
            self._rows.put(kept)
        else:
            self._rows.clear()
        if carry is not None:
            self._carry.update(carry)
        due = min([t for t in (wake, *(r[0] for r in waiting)) if t is not None], default=None)
        if due is not None:
            self._handle.registerTimer(-(-due // 1000))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.result])

    def _stored(self) -> list[tuple]:
        return [(t, i, d, list(p) if isinstance(p, (list, tuple)) else p) for t, i, d, p in self._rows.get()] if self._rows.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for f in rows:
            new += [(int(t), int(i), False, p.tolist() if hasattr(p, "tolist") else p) for t, i, p in zip(f["t"], f["id"], f["payload"])]
        yield from self._advance(key, self._stored() + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self._stored(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _stream(events: DataFrame, key: str, ts: str, row_id: str, payload: Column, processor: _InOrder, result: str, late: str) -> DataFrame:
    rows = events.withWatermark(ts, late).filter(F.col(ts).isNotNull()).select(
        F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(row_id).cast("long").alias("id"), payload.alias("payload"), F.col(ts).alias("ts"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, {result}", "append", "EventTime").withColumnRenamed("key", key)


# ---- stability of what is seen: mean token overlap with the newest frame over the last moments

def token_overlap(a: Sequence[str], b: Sequence[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


class _Stability(_InOrder):
    payload, carried, result = "array<string>", "none int", ("id", "seen", "similarity", "stable")

    def __init__(self, ms: int, least: int, similarity: float):
        self.us, self.least, self.similarity = ms * 1000, least, similarity

    def step(self, carry, past, ready, now):
        out, seen = [], past + ready
        for t, i, _, tokens in ready:
            window = [r for r in seen if t - self.us <= r[0] <= t]
            mean = round(sum(token_overlap(tokens, r[3]) for r in window) / len(window), 9)
            out.append((i, len(window), mean, len(window) >= self.least and mean >= self.similarity))
        keep = [r for r in seen if r[0] >= now - self.us]
        return out, None, keep, max(r[0] for r in keep) + self.us + 1 if keep else None


def stability_stream(frames: DataFrame, key: str, ts: str, row_id: str, tokens: str, late: str, ms: int = 2600, least: int = 3, similarity: float = 0.72) -> DataFrame:
    """(key, id, seen, similarity, stable) of every frame: the frames of its key in the last ``ms``, the mean overlap of their token sets with its own, and
    whether there are ``least`` of them that overlap by ``similarity``."""
    return _stream(frames, key, ts, row_id, F.col(tokens), _Stability(ms, least, similarity), "id long, seen long, similarity double, stable boolean", late)


def stability_table(frames: DataFrame, key: str, ts: str, row_id: str, tokens: str, ms: int = 2600, least: int = 3, similarity: float = 0.72) -> DataFrame:
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(t).rangeBetween(-ms * 1000, 0)
    union = lambda x: F.size(F.array_union(x, F.col(tokens)))
    overlap = lambda x: F.when(union(x) > 0, F.size(F.array_intersect(x, F.col(tokens))) / union(x)).otherwise(0.0)
    df = frames.filter(F.col(ts).isNotNull()).withColumn("_w", F.collect_list(tokens).over(w)).withColumn("seen", F.size("_w").cast("long"))
    df = df.withColumn("similarity", F.round(F.aggregate("_w", F.lit(0.0), lambda s, x: s + overlap(x)) / F.col("seen"), 9))
    return df.select(key, F.col(row_id).alias("id"), "seen", "similarity", ((F.col("seen") >= least) & (F.col("similarity") >= similarity)).alias("stable"))


# ---- how long a picture has been still

class _Still(_InOrder):
    payload, carried, result = "array<double>", "t long, metrics array<double>, us long", ("id", "stable_ms", "score")

    def __init__(self, delta: float, full_ms: float):
        self.delta, self.full = delta, full_ms

    def step(self, carry, past, ready, now):
        out = []
        for t, i, _, m in ready:
            us = 0
            if carry is not None and round(sum(abs(a - b) for a, b in zip(carry[1], m)), 9) < self.delta:
                us = carry[2] + t - carry[0]
            carry = (t, m, us)
            out.append((i, us / 1000, min(1.0, us / 1000 / self.full)))
        return out, carry, [], None


def still_stream(frames: DataFrame, key: str, ts: str, row_id: str, metrics: Sequence[str], late: str, delta: float = 0.18, full_ms: float = 900) -> DataFrame:
    """(key, id, stable_ms, score): the time since the metrics of two frames in a row last differed by ``delta`` or more in sum, and its share of ``full_ms``."""
    return _stream(frames, key, ts, row_id, F.array(*[F.col(m).cast("double") for m in metrics]), _Still(delta, full_ms), "id long, stable_ms double, score double", late)


def still_table(frames: DataFrame, key: str, ts: str, row_id: str, metrics: Sequence[str], delta: float = 0.18, full_ms: float = 900) -> DataFrame:
    w = W.partitionBy(key).orderBy("_t", row_id)
    df = frames.filter(F.col(ts).isNotNull()).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    change = sum((F.abs(F.col(m) - F.lag(m).over(w)) for m in metrics), F.lit(0.0))
    df = df.withColumn("_moved", F.coalesce(F.round(change, 9) >= delta, F.lit(True))).withColumn("_us", F.when(F.col("_moved"), 0).otherwise(F.col("_t") - F.lag("_t").over(w)))
    df = df.withColumn("_island", F.sum(F.col("_moved").cast("int")).over(w))
    ms = F.sum("_us").over(W.partitionBy(key, "_island").orderBy("_t", row_id)) / 1000
    return df.select(key, F.col(row_id).alias("id"), ms.alias("stable_ms"), F.least(F.lit(1.0), ms / full_ms).alias("score"))


# ---- one period of accumulation per key, then a lock

class _Period(_InOrder):
    payload, carried, result = "double", "start long, n long, best double, locked boolean", ("kind", "id", "at", "n", "best")

    def __init__(self, ms: int):
        self.us = ms * 1000

    def step(self, carry, past, ready, now):
        out = []

        def lock():
            start, n, best, _ = carry
            out.append(("locked", None, start + self.us, n, best))
            return start, n, best, True

        for t, i, _, value in ready:
            carry = carry or (t, 0, None, False)
            if not carry[3] and t >= carry[0] + self.us:
                carry = lock()
            if carry[3]:
                out.append(("rejected", i, t, None, None))
            else:
                best = carry[2] if value is None or value != value else value if carry[2] is None else max(carry[2], value)
                carry = (carry[0], carry[1] + 1, best, False)
        if carry and not carry[3] and now >= carry[0] + self.us:
            carry = lock()
        return out, carry, [], None if carry is None or carry[3] else carry[0] + self.us


def period_stream(events: DataFrame, key: str, ts: str, row_id: str, value: str, late: str, ms: int = 2000) -> DataFrame:
    """(key, kind, id, at, n, best): once per key, ``ms`` after its first row, a row of kind locked with what has accumulated by then; every later row comes out as rejected."""
    df = _stream(events, key, ts, row_id, F.col(value).cast("double"), _Period(ms), "kind string, id long, at long, n long, best double", late)
    return df.withColumn("at", F.timestamp_micros("at"))


def period_table(events: DataFrame, key: str, ts: str, row_id: str, value: str, ms: int = 2000) -> DataFrame:
    df = events.filter(F.col(ts).isNotNull()).select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(row_id).cast("long").alias("id"), F.col(value).cast("double").alias("_v"))
    df = df.withColumn("_end", F.min("_t").over(W.partitionBy(key)) + ms * 1000)
    locked = df.filter("_t < _end").groupBy(key).agg(F.max("_end").alias("at"), F.count("*").alias("n"), F.max(F.nanvl("_v", F.lit(None))).alias("best")).select(
        key, F.lit("locked").alias("kind"), F.lit(None).cast("long").alias("id"), "at", "n", "best")
    rejected = df.filter("_t >= _end").select(key, F.lit("rejected").alias("kind"), "id", F.col("_t").alias("at"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("best"))
    return locked.union(rejected).withColumn("at", F.timestamp_micros("at"))


# ---- leases that run out

class _Lease(_InOrder):
    payload, carried, result = "boolean", "last long, recoveries int, cancel boolean, held boolean, closed boolean", ("at", "recoveries", "status")

    def __init__(self, ms: int, attempts: int):
        self.us, self.attempts = ms * 1000, attempts

    def step(self, carry, past, ready, now):
        out = []
        last, n, cancel, held, closed = carry or (0, 0, False, False, False)

        def expire(n):
            status = "cancelled" if cancel else "failed" if n + 1 >= self.attempts else "queued"
            out.append((last + self.us, n + 1, status))
            return n + 1, False, status != "queued"

        for t, _, _, stop in ready:
            if held and t > last + self.us:
                n, held, closed = expire(n)
            if not closed:
                last, cancel, held = t, cancel or bool(stop), True
        if held and now > last + self.us:
            n, held, closed = expire(n)
        return out, (last, n, cancel, held, closed), [], last + self.us + 1 if held else None


def lease_stream(beats: DataFrame, job: str, ts: str, row_id: str, cancel: str, late: str, ms: int, attempts: int = 3) -> DataFrame:
    """(job, at, recoveries, status) each time a job has sent no heartbeat for ``ms``: cancelled if it was asked to stop, failed at the ``attempts``-th time, else
    queued again; a heartbeat takes a queued job up, after cancelled or failed none counts."""
    df = _stream(beats, job, ts, row_id, F.coalesce(F.col(cancel), F.lit(False)), _Lease(ms, attempts), "at long, recoveries int, status string", late)
    return df.withColumn("at", F.timestamp_micros("at"))


def lease_table(beats: DataFrame, job: str, ts: str, row_id: str, cancel: str, ms: int, now: Column, attempts: int = 3) -> DataFrame:
    w = W.partitionBy(job).orderBy("_t", row_id)
    df = beats.filter(F.col(ts).isNotNull()).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    end = F.col("_t") + ms * 1000
    df = df.withColumn("_cancel", F.max(F.coalesce(cancel, F.lit(False))).over(w)).withColumn("_next", F.coalesce(F.lead("_t").over(w), F.unix_micros(now))).filter(end < F.col("_next"))
    df = df.withColumn("recoveries", F.row_number().over(w))
    status = F.when(F.col("_cancel"), "cancelled").when(F.col("recoveries") >= attempts, "failed").otherwise("queued")
    df = df.withColumn("status", status).withColumn("_over", F.count_if(F.col("status") != "queued").over(w.rowsBetween(W.unboundedPreceding, -1)))
    return df.filter("_over = 0").select(job, F.timestamp_micros(end).alias("at"), "recoveries", "status")
