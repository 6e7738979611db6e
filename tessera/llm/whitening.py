"""Whitening of integer vectors onto the leading principal components, by spectrum slicing.

The covariance is exact: tasks subtract the integer part of the mean before multiplying, add up integer products, and the driver
takes the fractional part of the mean out in rational arithmetic and rounds once.

For a shift s the factorisation P(V - sI)P' = LDL' has as many positive entries (or eigenvalues of 2 x 2 blocks) in D as V has
eigenvalues above s.  These counts slice the spectrum until every leading eigenvalue has an interval of its own; Rayleigh
quotient iteration inside the interval then converges cubically, and two more counts, just below and just above the result, certify
that it is the eigenvalue of that number.  Eigenvalues that no double can tell apart share an interval; their
vectors are made orthogonal, and any basis of their space is as good as another.

The fit list holds each distinct vector once; copies are merged before the shuffle.  The products of a task are one row per pair of
dimensions, so dim^2 / 2 rows of each task are shuffled and as many come to the driver.  All rows are whitened, and
the error that is returned is measured on the whitened fit list.

Rows whose vector is null, empty, or holds a null or non-finite entry are left out.  Entries beyond 2^40 in size count as 2^40.  Vectors of
each length are a list of their own, with its own components.  Components whose eigenvalue is zero (at most 1e-13 of
the trace) have no whitened value and are left out; so one distinct vector, or an empty table, gives no row.  Null and repeated ids are
rows like others.  A deviation that no long holds is null.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialize

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_LONG = 2**63 - 1


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are above ``shift``: the positive inertia of V - shift I, by LDL' with
    complete pivoting (1 x 1 or 2 x 2, whichever grows less)."""
    a = v - shift * np.eye(len(v))
    bound, positive = (1 + 17**0.5) / 8, 0
    while len(a):
        i = int(np.argmax(np.abs(np.diag(a))))
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = np.unravel_index(int(np.argmax(off)), a.shape)
        if abs(a[i, i]) >= bound * off[p, q]:
            if a[i, i] == 0:  # nothing is left but zeros
                return positive
            positive += a[i, i] > 0
            rest = np.delete(np.arange(len(a)), i)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, i], a[i, rest]) / a[i, i]
        else:
            pair = np.array([p, q])
            block = a[np.ix_(pair, pair)]
            det, trace = np.linalg.det(block), block[0, 0] + block[1, 1]
            positive += 1 if det < 0 else 2 * (trace > 0)
            rest = np.delete(np.arange(len(a)), pair)
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, pair)] @ np.linalg.solve(block, a[np.ix_(pair, rest)])
    return int(positive)


def _iterate(v: np.ndarray, low: float, high: float, found: np.ndarray, seed: int) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of (low, high], orthogonal to ``found``; None if it leaves the interval."""
    scale = np.abs(v).max()
    x = np.random.default_rng([seed, len(found)]).standard_normal(len(v))
    shift, eye, best = (low + high) / 2, np.eye(len(v)), None
    slack = 4 * np.finfo(float).eps * scale * len(v)
    for step in range(40):
        try:
            y = np.linalg.solve(v - shift * eye, x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(v - (shift + slack) * eye, x)
        for _ in range(2):
            y = y - found.T @ (found @ y)
        x = y / np.linalg.norm(y)
        e = x @ v @ x
        rest = np.linalg.norm(v @ x - e * x)
        if step >= 2:  # the first steps keep the middle as shift, so that the vector turns to the interval's eigenvector
            if not low - slack <= e <= high + slack:
                return None
            if best is not None and rest >= best[0]:
                break
            best, shift = (rest, e, x), e
    return best[1], best[2]


def leading(v: np.ndarray, most: int, seed: int = 12, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above ``least``, falling, and their unit vectors as rows."""
    dim = len(v)
    reach = float(np.abs(v).sum(axis=1).max())  # no eigenvalue is beyond it
    tight = 8 * np.finfo(float).eps * max(reach, np.finfo(float).tiny) * dim
    count: dict[float, int] = {}

    def n_above(s: float) -> int:
        if s not in count:
            count[s] = above(v, s)
        return count[s]

    values, vectors = [], np.empty((0, dim))
    for number in range(1, min(most, n_above(least)) + 1):
        # the slice that holds eigenvalue ``number``: counts above its lower end >= number > counts above its upper end
        low = max((s for s, c in count.items() if c >= number), default=least)
        high = min((s for s, c in count.items() if c < number), default=reach * (1 + 1e-12) + tight)
        while True:
            alone = n_above(low) == number and n_above(high) == number - 1
            if (alone or high - low <= tight) and (got := _iterate(v, low, high, vectors, seed)):
                e, x = got
                gap = tight + abs(e) * 1e-12
                if n_above(e - gap) >= number > n_above(e + gap):  # certified: it is eigenvalue ``number``
                    break
            if high - low <= tight / 4:
                raise ArithmeticError(f"eigenvalue {number} isn't found between {low} and {high}")
            middle = (low + high) / 2
            if n_above(middle) >= number:
                low = middle
            else:
                high = middle
        values.append(float(e))
        vectors = np.vstack([vectors, x])
    return np.array(values), vectors


def covariance(n: int, rest: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """V from integer sums over d = x - base: (n * sum d_i d_j - sum d_i * sum d_j) / n^2, rounded once."""
    v = np.empty((len(rest), len(rest)))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = float(Fraction(n * p - rest[i] * rest[j], n * n))
    return v


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _products(base: np.ndarray):
    """Exact sums of d_i d_j of a task, d = x - base."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(base)
        total = np.zeros((dim, dim), object)
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                d = _matrix(part.column(0), part.num_rows) - base
                if np.abs(d).max() <= 2**20:  # products of 40 bits, 2,048 of them: a double holds the sum
                    f = d.astype(np.float64)
                    total += (f.T @ f).astype(np.int64)
                else:
                    o = d.astype(object)
                    total += o.T @ o
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([Decimal(int(x)) for x in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "p"])
    return run


class Whitener:
    """The fitted components of one length; ``parts`` gives of integer vectors the whitened values and exact deviations."""

    def __init__(self, n: int, base: np.ndarray, rest: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.base, self.rest, self.values, self.vectors, self.trace = n, base, rest, values, vectors, trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: n * (x - base) - (S - n * base)."""
        d = x - self.base
        if int(np.abs(d).max(initial=0)) * self.n + int(np.abs(self.rest).max(initial=0)) >= 2**62:
            d = d.astype(object)
        return d * self.n - self.rest.astype(d.dtype)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        c = self.centred(x)
        w = (c.astype(np.float64) / self.n) @ self.vectors.T / np.sqrt(self.values)
        if c.dtype != object and len(c) and int(np.abs(c).max()) ** 2 * c.shape[1] > _LONG:
            c = c.astype(object)
        return w, [int(s) if s <= _LONG else None for s in (c * c).sum(axis=1)]


def _gram(fit: Whitener):
    """Of a task: sums and products of whitened values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                w, _ = fit.parts(_matrix(part.column(0), part.num_rows))
                w = np.hstack([w, np.ones((len(w), 1))])
                total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "p"])
    return run


def _whiten(fits: dict[int, tuple[Whitener, float]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for s in range(0, len(whole), 4096):
                f = whole.iloc[s:s + 4096]
                for dim, g in f.groupby(f["x"].map(len)):
                    if dim not in fits:
                        continue
                    fit, error = fits[dim]
                    k = len(fit.values)
                    w, deviation = fit.parts(np.stack(g["x"].to_list()))
                    yield pd.DataFrame({
                        "vec_id": g["vec_id"].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(g)), "n": fit.n,
                        "deviation": pd.array(deviation, "Int64").repeat(k), "whitened": w.ravel(),
                        "explained": np.tile(fit.values / fit.trace, len(g)), "identity_error": error})
    return run


def _sums(df: DataFrame, task: Callable, kind: str) -> dict[tuple[int, int], object]:
    """Sums by (i, j) over all tasks; dim^2 / 2 rows come to the driver."""
    part = df.select("x").mapInArrow(task, f"i long, j long, p {kind}").groupBy("i", "j").agg(F.sum("p").alias("p"))
    return {(r["i"], r["j"]): r["p"] for r in part.collect()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """Return (vec_id, component, n, deviation, whitened, explained, identity_error): a row per kept vector and component."""
    spark = vectors.sparkSession
    whole = F.expr("size(v) > 0") & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(whole)
    edge = F.lit(float(2**40))
    rows = materialize(src.select("vec_id", F.transform("v", lambda c: F.floor(F.least(F.greatest(c, -edge), edge) * scale) + offset).alias("x")), "op12")
    fit_list = materialize(rows.select("x").distinct(), "op12fit")
    fits: dict[int, tuple[Whitener, float]] = {}
    heads = fit_list.select(F.size("x").alias("dim"), F.posexplode("x").alias("i", "c")).groupBy("dim", "i").agg(
        F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).collect()  # a row per length and place
    for dim in sorted({r["dim"] for r in heads}):
        own = {r["i"]: r for r in heads if r["dim"] == dim}
        n, s = own[0]["n"], [int(own[i]["s"]) for i in range(dim)]
        base = [t // n for t in s]
        rest = [t - n * b for t, b in zip(s, base)]
        listed = fit_list.filter(F.size("x") == dim)
        base, products = np.array(base, np.int64), _sums(listed, _products(np.array(base, np.int64)), "decimal(38,0)")
        v = covariance(n, rest, {k: int(p) for k, p in products.items()})
        trace = float(np.trace(v))
        if not trace:
            continue
        values, basis = leading(v, components, least=1e-13 * trace)
        fit = Whitener(n, base, np.array(rest, np.int64), values, basis, trace)
        gram, k = _sums(listed, _gram(fit), "double"), len(values)
        error = max(abs(gram[i, j] / n - gram[i, k] * gram[j, k] / n**2 - (i == j)) for i in range(k) for j in range(i, k))
        fits[dim] = (fit, float(error))
    discard(fit_list)
    return rows.mapInPandas(_whiten(fits), RESULT) if fits else spark.createDataFrame([], RESULT)
