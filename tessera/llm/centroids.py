"""Clustering of integer vectors around centroids, by equal-average equal-variance search.

For a vector x with component sum s(x) and deviation v(x) = |x - mean|, and a centroid c likewise,

    |x - c|^2 = (s(x) - s(c))^2 / dim + |(x - mean) - (c - mean)|^2 >= (s(x) - s(c))^2 / dim + (v(x) - v(c))^2.

Centroids are sorted by their sum.  The search begins at the sum nearest to the vector's and goes outward on both sides, always
to the nearer one; it ends once the first term alone is above the best distance (all further ones are), and passes over
a centroid whose two terms are.  What is left is compared exactly in integers.  The bounds are taken a little
below their value in doubles, so rounding never rejects a nearest centroid, and of equal distances the smaller number wins.

Each round is one pass over the vectors, written once: tasks hold the centroids (k * dim integers), add up their own
vectors' components exactly, and only k * dim sums of each task are shuffled.  Sums are decimals of 38 digits.

Vectors that are null, of another length, or hold a null or non-finite component are left out.  Components whose integer lies
beyond 2^61 count as that; where integers are so large that a squared distance may leave a long, Python integers take
over and a larger distance is given as the largest long.  Repeated rows are vectors each; a null id is kept, has no hash and so
comes last for the first centroids; equal hashes are ordered by components.  Fewer than k vectors give as
many centroids; an empty table an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialize

LONG = 2**63 - 1
#: Integers beyond this size count as it, so differences stay in a long.
_SAFE = 2**61


def integers(vec: str, scale: int) -> F.Column:
    """The components times ``scale``, rounded down."""
    return F.transform(F.col(vec), lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-float(_SAFE))), F.lit(float(_SAFE)))))


def _exact(x: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """``x`` as it is where all squared distances fit a long, else in Python integers."""
    most = max((int(np.abs(y).max()) for y in (x, *others) if y.size), default=0)
    return x if x.shape[1] * (2 * most) ** 2 <= LONG else x.astype(object)


class Codebook:
    """Centroids sorted by component sum, ready to be searched."""

    def __init__(self, centroids: np.ndarray):
        self.c = np.asarray(centroids)
        f = self.c.astype(np.float64)
        self.order = np.argsort(f.sum(axis=1), kind="stable")
        f = f[self.order]
        self.sums, self.dev = f.sum(axis=1), np.linalg.norm(f - f.mean(axis=1, keepdims=True), axis=1)
        self.size = np.abs(f).sum(axis=1).max()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance, distances computed) of the nearest centroid of each row of ``x``."""
        n, k, dim = len(x), len(self.c), x.shape[1]
        x = _exact(x, self.c)
        c = self.c.astype(x.dtype)
        f = x.astype(np.float64)
        s = f.sum(axis=1)
        v = np.linalg.norm(f - s[:, None] / dim, axis=1)
        slack = 1e-12 * (np.abs(f).sum(axis=1) + self.size)  # more than rounding can move a sum or a deviation
        best = np.full(n, LONG, x.dtype)
        number = np.full(n, k, np.int64)
        high = np.searchsorted(self.sums, s)
        low, todo, computed = high - 1, np.arange(n), 0
        while len(todo):
            up = np.where(high[todo] < k, np.abs(self.sums[np.minimum(high[todo], k - 1)] - s[todo]), np.inf)
            down = np.where(low[todo] >= 0, np.abs(s[todo] - self.sums[np.maximum(low[todo], 0)]), np.inf)
            rise = up < down
            gap = np.maximum(np.where(rise, up, down) - slack[todo], 0.0)
            first = number[todo] == k
            open_ = np.isfinite(gap) & (first | (gap * gap / dim * (1 - 1e-9) <= best[todo].astype(np.float64)))
            todo, rise, gap, first = todo[open_], rise[open_], gap[open_], first[open_]
            at = np.where(rise, high[todo], low[todo])
            high[todo] += rise
            low[todo] -= ~rise
            apart = np.maximum(np.abs(v[todo] - self.dev[at]) - slack[todo], 0.0)
            near = first | ((gap * gap / dim + apart * apart) * (1 - 1e-9) <= best[todo].astype(np.float64))
            i, j = todo[near], self.order[at[near]]
            if len(i):
                d = ((x[i] - c[j]) ** 2).sum(axis=1)
                computed += len(i)
                better = (number[i] == k) | (d < best[i]) | ((d == best[i]) & (j < number[i]))
                best[i[better]], number[i[better]] = d[better], j[better]
        return number, best, computed


def _batches(batches: Iterator[pa.RecordBatch], column: int, dim: int, most: int = 4096):
    for b in batches:
        for i in range(0, b.num_rows, most):
            part = b.slice(i, most)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def _totals(book: Codebook, dim: int):
    """Of one task: for each centroid and component the sum and the number of its vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(book.c)
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for _, x in _batches(batches, 0, dim):
            number, _, _ = book.nearest(x)
            count += np.bincount(number, minlength=k)
            y = x if np.abs(x).max() < 2**50 else x.astype(object)
            for j in np.unique(number):
                total[j] += y[number == j].sum(axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(used, dim), pa.int64()), pa.array(np.tile(np.arange(dim), len(used)), pa.int64()),
            pa.array([Decimal(int(t)) for t in total[used].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(count[used], dim), pa.int64())],
            ["cluster", "place", "total", "n"])
    return run


def _assign(book: Codebook, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _batches(batches, 1, dim):
            number, d, _ = book.nearest(x)
            d = np.minimum(d, LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])
    return run


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10,
                      scale: int = 1024, seed: int = 3) -> DataFrame:
    """Return (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``."""
    spark = vectors.sparkSession
    whole = F.expr("size(v) = " + str(dim)) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(whole)
    kept = materialize(src.select("vec_id", integers("v", scale).alias("x")), "op11")
    first = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    start = first.orderBy(F.asc_nulls_last("h"), "x").limit(k).select("x").collect()
    if not start:
        discard(kept)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array([r["x"] for r in start], np.int64)
    for _ in range(rounds):
        part = kept.select("x").mapInArrow(_totals(Codebook(c), dim), "cluster long, place long, total decimal(38,0), n long")
        moved = c.copy()
        for r in part.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k * dim rows
            moved[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        if (moved == c).all():  # the rounds left would change nothing
            break
        c = moved
    found = materialize(kept.mapInArrow(_assign(Codebook(c), dim), "vec_id long, cluster int, distance long"), "op11out")
    discard(kept)
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    rows = [(j, min(d, LONG), min(sum(sums.values()), LONG), ",".join(map(str, c[j].tolist()))) for j, d in sums.items()]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")  # k rows
    return found.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
