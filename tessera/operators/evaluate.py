"""Evaluation of ranked results against truth, grids of configurations, folds and bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_metrics(ranks: DataFrame, by: Sequence[str] = (), rank: str = "rank", ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Top-k accuracy, mean reciprocal rank and mean rank; a null rank is a miss."""
    r = F.col(rank)
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))).alias(f"top{k}") for k in ks],
                                  F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), F.avg(r.cast("double")).alias("mean_rank"))


def versus_baseline(df: DataFrame, by: Sequence[str], new: str = "new_ok", old: str = "old_ok") -> DataFrame:
    """Right, fixed and broken counts of a new decision against an old one."""
    n, o = F.col(new), F.col(old)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(n).alias("exact"), F.count_if(n & ~o).alias("fixed"), F.count_if(~n & o).alias("broken"))


def macro(per_group: DataFrame, value: str) -> DataFrame:
    return per_group.agg(F.avg(value).alias(f"macro_{value}"), F.count("*").alias("groups"))


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    q = F.percentile(v, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    d = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return d.select(*by, "n", "min", *[F.col("q")[i].alias(f"p{p:02d}") for i, p in enumerate((5, 25, 50, 75, 95))], "max", "mean", "std")


def pool_recall_grid(ranks: DataFrame, grid: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Recall of each configuration (config, one depth column per source) from the truth's rank per source (one column each).
    The rank table is first counted by its distinct rank vectors, so the grid meets few rows."""
    counted = ranks.groupBy(*sources).agg(F.count("*").alias("c"))
    g = F.broadcast(grid.select("config", *[F.col(s).alias(f"_k_{s}") for s in sources]))
    hit = F.lit(False)
    for s in sources:
        hit = hit | F.coalesce(F.col(s) <= F.col(f"_k_{s}"), F.lit(False))
    return counted.crossJoin(g).groupBy("config").agg(F.sum("c").alias("n"), F.sum(F.when(hit, F.col("c")).otherwise(0)).alias("found"))


def leave_one_out(per_config: DataFrame, group: str = "dataset", config: str = "config", n: str = "n", ok: str = "ok") -> DataFrame:
    """Nested selection: for each left-out dataset the configuration best on the others (ties to the first), and its result there."""
    total = per_config.groupBy(config).agg(F.sum(n).alias("tn"), F.sum(ok).alias("tok"))
    inner = per_config.join(total, config).withColumn("others", (F.col("tok") - F.col(ok)) / F.greatest(F.col("tn") - F.col(n), F.lit(1)))
    best = inner.groupBy(group).agg(F.max_by(F.struct(config, n, ok), F.struct(F.round("others", 12), -F.col(config))).alias("b"))
    return best.select(group, F.col(f"b.{config}").alias(config), F.col(f"b.{n}").alias(n), F.col(f"b.{ok}").alias(ok))


def nested_selection(rows: DataFrame, dataset: str, value: str, truth: str, factors: Sequence[float]) -> DataFrame:
    """(dataset, config, inner_macro, n, ok): a threshold classifier (value > factor * mean of the fitting rows) chosen by nested folds.

    For each left-out dataset and each other one, every factor is fitted without both and judged on the other; the factor with the best mean accuracy over the
    others (then the most right rows, then the first) is fitted without the left-out one and judged there.  Fits come from the datasets' sums, and one scan
    counts each row's place among its dataset's thresholds, so selection costs no further scan.  Datasets are few (a stated list); the rows are any number."""
    sums = rows.groupBy(dataset).agg(F.count(value).alias("_n"), F.sum(F.col(value).cast("double")).alias("_s"))
    total = sums.agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    out = sums.select(F.col(dataset).alias("outer"), F.col("_n").alias("_on"), F.col("_s").alias("_os"))
    judged = sums.select(F.col(dataset).alias("judged"), F.col("_n").alias("_jn"), F.col("_s").alias("_js"))
    same = F.col("outer") == F.col("judged")
    rest = lambda t, o, j: F.col(t) - F.col(o) - F.when(same, 0).otherwise(F.col(j))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("config"), F.lit(float(f)).alias("factor")) for i, f in enumerate(factors)]))
    folds = out.crossJoin(F.broadcast(judged)).crossJoin(F.broadcast(total)).withColumn("g", grid)  # datasets by datasets by factors
    folds = folds.select("outer", "judged", "g.config", F.round(F.col("g.factor") * rest("_ts", "_os", "_js") / F.nullif(rest("_tn", "_on", "_jn"), F.lit(0)), 6).alias("cut")).filter("cut is not null")
    cuts = folds.groupBy(F.col("judged").alias(dataset)).agg(F.array_sort(F.collect_set("cut")).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda x: x < F.col(value)))
    counted = rows.filter(F.col(value).isNotNull() & F.col(truth).isNotNull()).join(F.broadcast(cuts), dataset).groupBy(F.col(dataset).alias("judged"), place.alias("_p")).agg(
        F.count("*").alias("_c"), F.count_if(F.col(truth)).alias("_t"))
    at = folds.join(cuts.withColumnRenamed(dataset, "judged"), "judged").withColumn("_i", F.array_position("_cuts", F.col("cut"))).drop("_cuts")
    hit = F.when(F.col("_p") >= F.col("_i"), F.col("_t")).otherwise(F.col("_c") - F.col("_t"))
    metrics = at.join(counted, "judged").groupBy("outer", "judged", "config").agg(F.sum("_c").alias("n"), F.sum(hit).alias("ok"))
    inner = metrics.filter(~same).groupBy("outer", "config").agg(F.round(F.avg(F.col("ok") / F.col("n")), 9).alias("inner_macro"), F.sum("ok").alias("_ok"))
    best = inner.groupBy("outer").agg(F.max_by(F.struct("config", "inner_macro"), F.struct("inner_macro", "_ok", -F.col("config"))).alias("_b")).select("outer", "_b.config", "_b.inner_macro")
    return best.join(metrics.filter(same).drop("judged"), ["outer", "config"]).select(F.col("outer").alias(dataset), "config", "inner_macro", "n", "ok")


def weight_grid(axes: dict[str, Sequence[float]]) -> list[dict[str, float]]:
    """All combinations of the axes' values, the last axis fastest."""
    out: list[dict[str, float]] = [{}]
    for name, values in axes.items():
        out = [{**c, name: v} for c in out for v in values]
    return out


def weight_grid_metrics(candidates: DataFrame, grid: Sequence[dict[str, float]], base: Column) -> DataFrame:
    """(config, dataset, n, exact, broken, siblings, base_exact, base_siblings) of every weighting in one pass: a query's candidates (query, dataset, cid, truth, sibling and the
    weighted columns), its pool, come together once; each weighting and the baseline ``base`` take their best of them to nine places, ties to the least cid.  Batches of pools are
    scored in numpy, some weightings at a time, and leave one row a weighting and dataset."""
    names = list(grid[0])
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    pool = F.collect_list(F.struct("cid", flag("truth"), flag("sibling"), F.round(base, 9).cast("double").alias("_base"), *[F.col(n).cast("double").alias(n) for n in names]))
    per = candidates.groupBy("query", "dataset").agg(pool.alias("_pool")).select("dataset", "_pool")
    counts = ("n", "exact", "broken", "siblings", "base_exact", "base_siblings")

    def best(score: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first row of the best score of each pool, one column a weighting."""
        top = np.repeat(np.maximum.reduceat(score, starts, axis=0), sizes, axis=0)
        at = np.where(score == top, np.arange(len(score))[:, None], len(score))
        return np.minimum.reduceat(at, starts, axis=0)

    def places(score: np.ndarray, null: np.ndarray, scale: float = 1e9) -> np.ndarray:
        """Scores to nine places, halves up; nulls least, as in Spark's order of structs, what is no number greatest."""
        r = np.where(np.isnan(score), np.inf, np.floor(score * scale + 0.5))
        r[null] = -np.inf
        return r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pools = b.column(1)
            flat = pools.flatten()
            sizes = pools.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(flat):
                continue
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            column = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
            truth, sibling = column("truth").astype(bool), column("sibling").astype(bool)
            order = np.lexsort((~sibling, ~truth, column("cid"), np.repeat(np.arange(len(sizes)), sizes)))
            truth, wrong = truth[order], (sibling & ~truth)[order]
            value = {c: (column(c).astype(np.float64)[order], flat.field(c).is_null().to_numpy(zero_copy_only=False)[order]) for c in ["_base", *names]}
            was = best(places(value["_base"][0], value["_base"][1])[:, None], starts, sizes)[:, 0]
            null = np.logical_or.reduce([value[n][1] for n in names])
            kinds, of = np.unique(pc.fill_null(pc.index_in(b.column(0), pc.unique(b.column(0))), -1).to_numpy(zero_copy_only=False), return_inverse=True)
            first = np.array([np.argmax(of == k) for k in range(len(kinds))])
            step = max(1, 2_000_000 // len(flat))
            for g in range(0, len(grid), step):
                some = grid[g:g + step]
                score = np.zeros((len(flat), len(some)))
                for n in names:
                    score = score + value[n][0][:, None] * np.array([float(w[n]) for w in some])[None, :]
                at = best(places(score, null), starts, sizes)
                ok, base_ok = truth[at], truth[was][:, None]
                per_query = (np.ones(ok.shape, bool), ok, base_ok & ~ok, wrong[at], np.broadcast_to(base_ok, ok.shape), np.broadcast_to(wrong[was][:, None], ok.shape))
                sums = {}
                for name, x in zip(counts, per_query):
                    s = np.zeros((len(kinds), len(some)), np.int64)
                    np.add.at(s, of, x)
                    sums[name] = s.ravel()
                config = np.tile(np.arange(g, g + len(some), dtype=np.int32), len(kinds))
                yield pa.RecordBatch.from_arrays([pa.array(config), b.column(0).take(pa.array(np.repeat(first, len(some)))), *[pa.array(sums[n]) for n in counts]], ["config", "dataset", *counts])

    parts = per.mapInArrow(run, f"config int, dataset {dict(per.dtypes)['dataset']}, " + ", ".join(f"{n} long" for n in counts))
    return parts.groupBy("config", "dataset").agg(*[F.sum(n).alias(n) for n in counts])


def feasible_weights(metrics: DataFrame, allowance: dict, most_broken: float = 0.2) -> DataFrame:
    """(config, macro, exact, broken, feasible).  Feasible: broken at most ``most_broken`` of the queries, each dataset of ``allowance`` at most that many right answers below the
    baseline, and no more sibling errors than the baseline."""
    kept = F.lit(True)
    for name, drop in allowance.items():
        kept &= (F.col("dataset") != name) | (F.col("exact") >= F.col("base_exact") - drop)
    return metrics.groupBy("config").agg(F.round(F.avg(F.col("exact") / F.col("n")), 9).alias("macro"), F.sum("exact").alias("exact"), F.sum("broken").alias("broken"),
                                         ((F.sum("broken") <= most_broken * F.sum("n")) & F.bool_and(kept) & (F.sum("siblings") <= F.sum("base_siblings"))).alias("feasible"))


def select_weights(metrics: DataFrame, allowance: dict, most_broken: float = 0.2) -> DataFrame:
    """The feasible config that is best by macro accuracy, then exact, then fewest broken, then the first; where none is feasible all compete."""
    return feasible_weights(metrics, allowance, most_broken).orderBy(F.desc("feasible"), F.desc("macro"), F.desc("exact"), "broken", "config").limit(1)


#: Distinct values of a group that are drawn together, and resamples that are.
_VALUES, _RESAMPLES = 4096, 250


def resample_means(df: DataFrame, by: str, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """(by, b, n, mean): the mean of each group under each resample, as many rows drawn with replacement as it has (n, exactly).

    Rows are counted by value first; a resample of a group is a multinomial draw of its values' counts.  A group with many values is drawn in two
    steps, how many rows each bucket of values gets and then which ones, which is the same law; so a task holds a bucket, not a group.  Draws are seeded by
    group, block of resamples and bucket: they do not depend on partitions.  Null values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(by).agg(F.ceil(F.count("*") / _VALUES).alias("_nb"))
    placed = counts.join(sizes, by).withColumn("bucket", F.expr("pmod(xxhash64(x), _nb)"))
    held = placed.groupBy(by, "bucket").agg(F.sort_array(F.collect_list(F.struct("x", "c"))).alias("held"), F.sum("c").alias("c"))
    blocks = df.sparkSession.range(-(-resamples // _RESAMPLES)).withColumnRenamed("id", "block")
    kind = dict(df.dtypes)[by]

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, key, block, own in f[[by, "_key", "block", "own"]].itertuples(index=False):
                c = np.array([r["c"] for r in own], np.int64)
                n = np.random.default_rng([seed, key & 0xFFFFFFFFFFFFFFFF, block]).multinomial(c.sum(), c / c.sum(), size=min(_RESAMPLES, resamples - block * _RESAMPLES))
                yield pd.DataFrame({by: [g] * len(c), "block": block, "bucket": [r["bucket"] for r in own], "drawn": list(n.T)})

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, key, block, bucket, drawn, own in f[[by, "_key", "block", "bucket", "drawn", "held"]].itertuples(index=False):
                x, c = np.array([r["x"] for r in own]), np.array([r["c"] for r in own], np.float64)
                w = np.random.default_rng([seed, key & 0xFFFFFFFFFFFFFFFF, block, bucket]).multinomial(np.asarray(drawn), c / c.sum())
                yield pd.DataFrame({by: [g] * len(w), "b": block * _RESAMPLES + np.arange(len(w)), "n": w.sum(axis=1), "s": w @ x})

    key = F.xxhash64(by).alias("_key")
    shares = held.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("bucket", "c"))).alias("own"))
    drawn = shares.crossJoin(F.broadcast(blocks)).select(by, key, "block", "own").mapInPandas(split, f"`{by}` {kind}, block long, bucket long, drawn array<long>")
    sums = drawn.join(held, [by, "bucket"]).select(by, key, "block", "bucket", "drawn", "held").mapInPandas(draw, f"`{by}` {kind}, b long, n long, s double")
    return sums.groupBy(by, "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(by, "b", "n", (F.col("s") / F.col("n")).alias("mean"))


def bootstrap_delta(df: DataFrame, by: str, delta: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(low, mid, high): the 95 % interval and the median of the macro mean of ``delta`` over resamples drawn within each group."""
    q = resample_means(df, by, delta, resamples, seed).groupBy("b").agg(F.avg("mean").alias("m")).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))


def truth_ranks(ranked: DataFrame, depth: dict[str, int]) -> DataFrame:
    """(query, rank_<source> ..., admitted_by): the truth's best rank in each source (rows with ``truth``) and the first source, in the given order, within whose
    depth it lies."""
    at = [F.min(F.when((F.col("source") == s) & F.col("truth"), F.col("rank"))).alias(f"rank_{s}") for s in depth]
    t = ranked.groupBy("query").agg(*at)
    return t.withColumn("admitted_by", F.coalesce(*[F.when(F.col(f"rank_{s}") <= k, F.lit(s)) for s, k in depth.items()]))


def ablation(scored: DataFrame, variants: dict[str, dict[str, float]], score: str = "source_score") -> DataFrame:
    """The first candidate (variant, query, cid, truth) under each variant's source weights, all from one pass over (query, source, cid, truth)."""
    total = {v: F.round(F.sum(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in w.items() for x in kv]), F.col("source")), F.lit(0.0)) * F.col(score)), 9) for v, w in variants.items()}
    seen = {v: F.bool_or(F.col("source").isin(*w)) for v, w in variants.items()}
    per = scored.groupBy("query", "cid").agg(F.bool_or("truth").alias("truth"), *[t.alias(f"t_{v}") for v, t in total.items()], *[s.alias(f"s_{v}") for v, s in seen.items()])
    best = per.groupBy("query").agg(*[F.max_by(F.struct("cid", "truth"), F.when(F.col(f"s_{v}"), F.struct(f"t_{v}", -F.col("cid")))).alias(v) for v in variants])
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("b")) for v in variants])
    return best.select("query", F.explode(rows).alias("r")).select("r.variant", "query", "r.b.cid", "r.b.truth").filter("cid is not null")


def extended_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``versus_baseline`` with the truth's presence in the pool, the accuracy where it is there, and errors inside the truth's group."""
    n, o, p = F.col("new_ok"), F.col("old_ok"), F.col("in_pool")
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(n).alias("exact"), F.count_if(n & ~o).alias("fixed"), F.count_if(~n & o).alias("broken"), F.count_if(p).alias("in_pool"),
                            F.count_if(n & p).alias("_h"), F.count_if(~n & F.col("same_group")).alias("same_group_errors"))
    return g.withColumn("conditional", F.col("_h") / F.nullif(F.col("in_pool"), F.lit(0))).drop("_h")
