"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors of a label recursively at random hyperplanes, one direction per tree and level and one threshold per
node; a vector close to a hyperplane goes to both sides (spill).  Vectors meet in the leaves of many trees, every meeting pair is
verified by its cosine in double precision, and verified pairs are united.

* Exact copies collapse first; links between copies are counted, not expanded.
* The split thresholds are fitted on a bounded sample of distinct vectors (``sample`` rows, the least by
  hash, so the choice is deterministic); every row is indexed.  The depth follows the number of distinct
  vectors of a label, so leaves keep their size as the input grows.
* A leaf of more than ``block`` vectors is compared in pairs of blocks, so no task holds more than two blocks.
* A pair that meets in several leaves is counted in the first one only: each vector carries its leaves, which are looked at for
  linked pairs alone, so no list of all pairs is built or de-duplicated.

Vectors are compared with those of the same label and length.  Vectors that are null, empty, zero, or hold a null or non-finite component, and rows
with a null label, link with nothing.  Repeated vec_ids are one vector each row; null vec_ids count as links
but name no component.  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.session import materialize


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, k, v): k a key of the vector's values, null where it cannot link; v the values as they are, single or double."""
    for b in batches:
        k, v, dims = [], [], []
        labels = b.column(1).to_pylist()
        for i, x in enumerate(b.column(2).to_pylist()):
            key = vec = None
            if x and labels[i] is not None and None not in x:
                y = np.asarray(x, np.float64) + 0.0
                if np.isfinite(y).all() and y.any():
                    vec = (single if (single := y.astype(np.float32)).astype(np.float64).tobytes() == y.tobytes() else y).tobytes()
                    key = xxhash.xxh3_64_intdigest(y.tobytes() + labels[i].encode()) - (1 << 63)
            k.append(key)
            v.append(vec)
            dims.append(len(x) if x else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k, pa.int64()), pa.array(v, pa.binary()), pa.array(dims, pa.int32())],
                                         ["vec_id", "label", "k", "v", "dim"])


def _vectors(v, dim: int) -> np.ndarray:
    """Unit vectors in double precision from the stored values."""
    if len(set(map(len, v))) == 1:
        u = np.frombuffer(b"".join(v), np.float32 if len(v[0]) == 4 * dim else np.float64).reshape(len(v), dim).astype(np.float64)
    else:
        u = np.array([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64) for x in v], np.float64)
    return u / np.linalg.norm(u, axis=1, keepdims=True)


@functools.lru_cache(maxsize=64)
def _directions(seed: int, tree: int, dim: int, depth: int) -> np.ndarray:
    """One unit direction per level, the same for all depths."""
    x = np.stack([np.random.default_rng([seed, tree, level, dim]).standard_normal(dim) for level in range(depth)], axis=1)
    return x / np.linalg.norm(x, axis=0)


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int, spill: float) -> list[np.ndarray]:
    """For each tree the thresholds of its nodes: node 1 is the root, 2n and 2n + 1 the sides.  Nodes that the sample does
    not reach split at zero."""
    forest = []
    for t in range(trees):
        cuts = np.zeros(1 << depth)
        p = sample @ _directions(seed, t, sample.shape[1], depth) if depth else None
        level = {1: np.arange(len(sample))}
        for j in range(depth):
            below = {}
            for node, i in level.items():
                if len(i) >= 4:
                    cuts[node] = c = np.median(p[i, j])
                    below[2 * node], below[2 * node + 1] = i[p[i, j] <= c + spill], i[p[i, j] >= c - spill]
            level = below
        forest.append(cuts)
    return forest


def _leaves(u: np.ndarray, cuts: np.ndarray, tree: int, depth: int, seed: int, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all vectors in one tree."""
    row, node = np.arange(len(u)), np.ones(len(u), np.int64)
    p = u @ _directions(seed, tree, u.shape[1], depth) if depth else None
    for j in range(depth):
        c = np.where(node < len(cuts), cuts[np.minimum(node, len(cuts) - 1)], 0.0)
        x = p[row, j]
        low, high = x <= c + spill, x >= c - spill
        row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
    return row, node


def _router(cuts: dict[int, list[np.ndarray]], depths: dict[tuple[str, int], int], trees: int, seed: int, spill: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (label, dim), g in f.groupby(["label", "dim"], sort=False):
                u = _vectors(g["v"].to_list(), dim)
                rows, leaves = [], []
                for t in range(trees):
                    row, node = _leaves(u, cuts[dim][t], t, depths[label, dim], seed, spill)
                    rows.append(row)
                    leaves.append((t << 40) | node)
                row, leaf = np.concatenate(rows), np.concatenate(leaves)
                order = np.lexsort((leaf, row))
                own = np.split(leaf[order], np.cumsum(np.bincount(row, minlength=len(g)))[:-1])
                yield pd.DataFrame({"k": g["k"], "label": g["label"], "dim": g["dim"], "w": g["w"], "v": g["v"], "leaves": own})
    return run


def _least_linked(n: int, cols: np.ndarray, met: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place of the component of each of ``n`` places; ``met`` holds (rows, linked to which of ``cols``)."""
    root = np.arange(n)
    while met:
        last = root.copy()
        for part, new in met:
            for at, other, linked in ((part, cols, new), (cols, part, new.T)):
                low = np.where(linked, root[other][None, :], n).min(axis=1)
                at, low = at[low < n], low[low < n]
                np.minimum.at(root, root[at], low)  # the root follows too, so whole trees move at once
                np.minimum.at(root, at, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == last).all():
            break
    return root


def _compare(least: float):
    """Pairs of one leaf or of two of its blocks -> one row per vector: links found here, and the least vector of its
    component under them."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k", ignore_index=True)  # places are in the order of keys, so the least place is the least vector
        leaf, bi, bj = int(g["leaf"].iloc[0]), int(g["bi"].iloc[0]), int(g["bj"].iloc[0])
        k, w, dim = g["k"].to_numpy(), g["w"].to_numpy(), int(g["dim"].iloc[0])
        u = _vectors(g["v"].to_list(), dim)
        rows = np.flatnonzero(g["block"].to_numpy() == bi)
        cols = rows if bi == bj else np.flatnonzero(g["block"].to_numpy() == bj)
        # earlier[i]: the earlier leaves that vector i is in, a bit each; a pair with one in common was counted there
        before = [np.asarray(x)[np.asarray(x) < leaf] for x in g["leaves"]]
        ids, at = np.unique(np.concatenate(before), return_inverse=True)
        earlier = np.zeros((len(g), max(1, -(-len(ids) // 8))), np.uint8)
        np.bitwise_or.at(earlier, (np.repeat(np.arange(len(g)), list(map(len, before))), at >> 3), (1 << (at & 7)).astype(np.uint8))
        links, met = np.zeros(len(g), np.int64), []
        for s in range(0, len(rows), 256):
            part = rows[s:s + 256]
            new = u[part] @ u[cols].T >= least
            new &= (k[part][:, None] < k[cols][None, :]) if bi == bj else True
            a, b = np.nonzero(new)
            for i in range(0, len(a), 1 << 16):
                x, y = a[i:i + (1 << 16)], b[i:i + (1 << 16)]
                new[x, y] = ~(earlier[part[x]] & earlier[cols[y]]).any(axis=1)
            links[part] += new @ w[cols]
            links[cols] += w[part] @ new
            if new.any():
                met.append((part, new))
        root = _least_linked(len(g), cols, met)
        hit = links > 0
        return pd.DataFrame({"k": k[hit], "links": links[hit], "root": k[root[hit]]})
    return run


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                         least: float = 0.93, trees: int = 8, spill: float = 0.015, leaf: int = 256, block: int = 1024,
                         sample: int = 20_000, seed: int = 7) -> DataFrame:
    """Return (vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                         F.col(vec_col).cast("array<double>").alias("v"))
    base = materialize(src.mapInArrow(_prepare, "vec_id long, label string, k long, v binary, dim int"), "op5base")
    ok = base.filter("k is not null")
    groups = materialize(ok.groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.min("label").alias("label"),
                                             F.min("v").alias("v"), F.min("dim").alias("dim")), "op5grp")
    counts = {(r["label"], r["dim"]): r["count"] for r in groups.groupBy("label", "dim").count().collect()}
    depths = {x: max(0, int(np.ceil(np.log2(n / leaf)))) for x, n in counts.items()}
    cuts: dict[int, list[np.ndarray]] = {}
    for dim in {d for _, d in counts}:
        got = groups.filter(F.col("dim") == dim).select("v", F.xxhash64("k").alias("o")).orderBy("o").limit(sample).toPandas()
        x = _vectors(got["v"].to_list(), dim)
        cuts[dim] = fit_forest(x, trees, min(max(n for (_, d), n in depths.items() if d == dim), int(np.log2(max(2, len(x) / 8)))), seed, spill)

    routed = groups.mapInPandas(_router(cuts, depths, trees, seed, spill),
                                "k long, label string, dim int, w long, v binary, leaves array<long>")
    routed = materialize(routed, "op5leaf")
    spread = routed.withColumn("leaf", F.explode("leaves"))
    size = spread.groupBy("label", "dim", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    spread = (spread.join(size, ["label", "dim", "leaf"])
              .withColumn("block", F.expr("int(pmod(xxhash64(k), nb))"))
              .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
              .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")))
    found = spread.groupBy("label", "dim", "leaf", "bi", "bj").applyInPandas(_compare(least), "k long, links long, root long")
    found = materialize(found, "op5hit")
    comp = connected_components(found.select("k", "root"), "k", "root").withColumnRenamed("node", "k")
    member = (groups.join(found.groupBy("k").agg(F.sum("links").alias("links")), "k", "left").join(comp, "k", "left")
              .withColumn("component", F.coalesce("component", "k")))
    name = member.groupBy("component").agg(F.min("rep").alias("cid"))
    named = member.join(name, "component").select("k", "cid", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    return base.select("vec_id", "k").join(named, "k", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("cid", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("cid", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
