"""Exact vector retrieval with deterministic ranks: score descending, then id ascending."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Up to so many queries go to the gallery; more of them meet it block by block, blocks of as many rows.
QUERY_BLOCK = 4096


def norm(v: str) -> Column:
    return F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(df: DataFrame, v: str) -> DataFrame:
    """Rows with a finite, non-zero vector, scaled to unit length in double precision."""
    n = norm(v)
    return df.filter(F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))).withColumn("_n", n).filter(
        (F.col("_n") > 0) & (F.col("_n") < float("inf"))).withColumn(v, F.transform(v, lambda x: x.cast("double") / F.col("_n"))).drop("_n")


def _unit(v: pd.Series) -> np.ndarray:
    m = np.vstack(v.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _some(q: pd.DataFrame, g: pd.DataFrame, cells: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """The queries in parts that make at most so many scores with the gallery rows (one query at least), so a task holds few at once."""
    step = max(1, cells // max(1, len(g)))
    for s in range(0, len(q), step):
        yield q.iloc[s:s + step]


def _scores(q: pd.DataFrame, g: pd.DataFrame, places: int, exclude_self: bool) -> np.ndarray:
    s = np.round(_unit(q["v"]) @ _unit(g["v"]).T, places)
    if exclude_self:
        s[q["query"].to_numpy()[:, None] == g["id"].to_numpy()[None, :]] = -np.inf
    return s


def against(gallery: DataFrame, queries: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int | None = None) -> DataFrame:
    """``kernel(some queries, some gallery rows)``, which makes their scores in parts (``_some``), for parts of both that together make every pair once; gallery: (id, v, ...), queries: (query, v, ...).

    Up to QUERY_BLOCK queries, counted first, go to the gallery's partitions and the gallery doesn't move.  More of them are dealt into blocks, as is the gallery, and
    blocks meet in the executors: each task holds one block of either side, nothing passes through the driver, and both sides may grow."""
    block = block or QUERY_BLOCK
    if queries.limit(block + 1).count() <= block:
        held = queries.toPandas()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f) and len(held):
                    yield kernel(held, f)
        return gallery.mapInPandas(run, schema)

    def dealt(df: DataFrame, key: str, own: str, other: str, own_blocks: int, other_blocks: int) -> DataFrame:
        return df.withColumn(own, F.expr(f"pmod(xxhash64({key}), {own_blocks})")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))).withColumn(other, F.col(other).cast("long"))

    nq, ng = (max(1, -(-df.count() // block)) for df in (queries, gallery))
    q, g = dealt(queries, "query", "_q", "_g", nq, ng), dealt(gallery, "id", "_g", "_q", ng, nq)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return kernel(left, right) if len(left) and len(right) else pd.DataFrame(columns=names)
    return q.groupBy("_q", "_g").cogroup(g.groupBy("_q", "_g")).applyInPandas(meet, schema)


def exact_topk(gallery: DataFrame, queries: DataFrame, k: int, gid: str = "id", qid: str = "query", vec: str = "v", exclude_self: bool = False, block: int | None = None) -> DataFrame:
    """(query, id, score, rank): the k best gallery rows of each query by cosine, exactly.  Each part of the gallery keeps its own k best of a query; the rest is a window over those."""
    def best(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], g["id"].to_numpy(np.int64)
        for part in _some(q, g):
            scores = _scores(part, g, 9, exclude_self)
            order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
            rows, flat = np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()
            ok = scores[rows, flat] > -np.inf
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[rows][ok], "id": ids[flat][ok], "score": scores[rows, flat][ok]}))
        return pd.concat(out)

    g = gallery.select(F.col(gid).cast("long").alias("id"), F.col(vec).alias("v")).filter("v is not null")
    q = queries.select(F.col(qid).cast("long").alias("query"), F.col(vec).alias("v")).filter("v is not null")
    w = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return against(g, q, best, "query long, id long, score double", block).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_per_label(gallery: DataFrame, queries: DataFrame, gid: str, qid: str, vec: str, label: str, exclude_self: bool = False, block: int | None = None) -> DataFrame:
    """(query, label, score): the best cosine of each query within each label; each part of the gallery gives one row a query and label."""
    def best(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lab, part in g.groupby("label", dropna=False):
            for some in _some(q, part):
                top = _scores(some, part, 9, exclude_self).max(axis=1)
                ok = top > -np.inf
                out.append(pd.DataFrame({"query": some["query"].to_numpy()[ok], "label": [lab] * int(ok.sum()), "score": top[ok]}))
        return pd.concat(out)

    g = gallery.select(F.col(gid).cast("long").alias("id"), F.col(vec).alias("v"), F.col(label).alias("label")).filter("v is not null")
    q = queries.select(F.col(qid).cast("long").alias("query"), F.col(vec).alias("v")).filter("v is not null")
    return against(g, q, best, f"query long, label {dict(gallery.dtypes)[label]}, score double", block).groupBy("query", "label").agg(F.max("score").alias("score"))


def score_summary(gallery: DataFrame, queries: DataFrame, key: str, vec: str, least: float, block: int | None = None) -> DataFrame:
    """(query, above, best): how many other gallery rows reach ``least`` by cosine, and the best one; each part of the gallery gives one row a query."""
    def summary(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for some in _some(q, g):
            s = _scores(some, g, 5, True)
            out.append(pd.DataFrame({"query": some["query"], "above": (s >= least).sum(axis=1), "best": s.max(axis=1)}))
        return pd.concat(out)

    g, q = (df.select(F.col(key).cast("long").alias(name), F.col(vec).alias("v")).filter("v is not null") for df, name in ((gallery, "id"), (queries, "query")))
    return against(g, q, summary, "query long, above long, best double", block).groupBy("query").agg(F.sum("above").alias("above"), F.max("best").alias("best"))


def expected_ranks(gallery: DataFrame, queries: DataFrame, key: str, vec: str, group: str, block: int | None = None) -> DataFrame:
    """(query, expected, strict, equivalent) from queries (query, v, expected, ev, group): the rank of the expected row among all others, ties by key, and the rank of the
    best row of its group.  Two passes over the gallery: the best of the group, then counts of what is better; each part gives one row a query."""
    def top(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for some in _some(q, g):
            own = some["group"].to_numpy()[:, None] == g["group"].to_numpy()[None, :]
            out.append(pd.DataFrame({"query": some["query"], "top": np.where(own, _scores(some, g, 9, True), -np.inf).max(axis=1)}))
        return pd.concat(out)

    def count(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], g["id"].to_numpy()
        for some in _some(q, g):
            s, expected = _scores(some, g, 9, True), some["expected"].to_numpy()
            s0 = np.round((_unit(some["v"]) * _unit(some["ev"])).sum(axis=1), 9)
            ahead = (s > s0[:, None]) | ((s == s0[:, None]) & (ids[None, :] < expected[:, None]))
            out.append(pd.DataFrame({"query": some["query"], "expected": expected, "strict": ahead.sum(axis=1), "equivalent": (s > some["top"].to_numpy()[:, None]).sum(axis=1)}))
        return pd.concat(out)

    g = gallery.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"), F.col(group).alias("group"))
    q = queries.select("query", "v", "expected", "ev", "group")
    best = against(g, q, top, "query long, top double", block).groupBy("query").agg(F.max("top").alias("top"))
    out = against(g, q.join(best, "query"), count, "query long, expected long, strict long, equivalent long", block)
    return out.groupBy("query", "expected").agg((F.sum("strict") + 1).alias("strict"), (F.sum("equivalent") + 1).alias("equivalent"))


def collapse_references(hits: DataFrame, cid: str, score: str = "score", ref: str = "id") -> DataFrame:
    """The best reference of each (query, catalog id)."""
    return hits.groupBy("query", cid).agg(F.max(score).alias("score"), F.max_by(ref, F.struct(score, -F.col(ref))).alias("reference"))


def phash_near(df: DataFrame, key: str, phash: str, most: int = 6) -> DataFrame:
    """Pairs of 64-bit hashes at most ``most`` bits apart: most + 2 parts, two of which must be equal (pigeonhole), so hashes meet under every two of them, and a pair counts under the first two
    that are equal.  Equal hashes are collapsed first, so a group of copies makes no pairs.

    The rows of a hash under all its parts are merged by shuffle whatever size Spark takes them to have: it doesn't count what an explode adds, so without the hint it broadcasts them through the driver."""
    reps = df.groupBy(phash).agg(F.min(key).alias("k"))
    n = most + 2
    long = lambda x: F.lit(x - (1 << 64 if x >> 63 else 0)).cast("long")
    ends = [64 * i // n for i in range(n + 1)]
    parts, tops = [(1 << e) - (1 << s) for s, e in zip(ends, ends[1:])], [1 << e - 1 for e in ends[1:]]
    # Of two parts: their bits, and the highest bit of each other part before the second.
    two = F.array(*[F.struct(long(parts[i] | parts[j]).alias("mask"), long(sum(tops[:j]) - tops[i]).alias("before")) for i, j in combinations(range(n), 2)])
    x = reps.select("k", F.col(phash).alias("h"), F.explode(two).alias("two")).select("k", "h", "two.mask", "two.before")
    a, b = x.alias("a").hint("merge"), x.alias("b")
    # Both columns tell which two parts; with both read on either side, the rows are dealt out once.
    equal = (F.col("a.before") == F.col("b.before")) & (F.col("a.h").bitwiseAND(F.col("a.mask")) == F.col("b.h").bitwiseAND(F.col("b.mask")))
    other, low = F.col("a.h").bitwiseXOR(F.col("b.h")), long(sum(parts[:-1]) - sum(tops[:-1]))
    # The sum carries into a part's highest bit if a lower one is set.  All parts in one go: a condition with a case for every two of them took over ten times the CPU time a task.
    unequal = (other.bitwiseAND(low) + low).bitwiseOR(other)
    return (a.join(b, equal & (F.col("a.k") < F.col("b.k"))).filter(F.bit_count(other) <= most).filter(F.bitwise_not(unequal).bitwiseAND(F.col("a.before")) == 0)
            .select(F.col("a.k").alias("a"), F.col("b.k").alias("b")))
