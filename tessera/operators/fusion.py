"""Fusion of several ranked sources: (query, source, cid, score, rank) in, one ranked list per query out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_by(df: DataFrame, score: str, tie: str = "cid", by: tuple[str, ...] = ("query",), name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie)))


def pool(ranked: DataFrame, depth: dict[str, int], offset: int = 60, most: int | None = None) -> DataFrame:
    """Nominations: each source's first ``depth`` rows, reciprocal-rank sums, rank; the first ``most`` of a query if given."""
    limit = F.create_map(*[F.lit(x) for kv in depth.items() for x in kv])
    p = (ranked.filter(F.col("rank") <= F.try_element_at(limit, F.col("source")))
         .groupBy("query", "cid").agg(F.round(F.sum(1.0 / (offset + F.col("rank"))), 12).alias("fusion"), F.array_sort(F.collect_set("source")).alias("sources")))
    p = rank_by(p, "fusion", name="fusion_rank")
    return p.filter(F.col("fusion_rank") <= most) if most else p


def minmax(ranked: DataFrame, score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 within (query, source); a constant list becomes 1."""
    w = W.partitionBy("query", "source")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return ranked.withColumn("scaled", F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0))


def source_scores(ranked: DataFrame, scaled: float = 0.75, reciprocal: float = 0.25) -> DataFrame:
    return minmax(ranked).withColumn("source_score", scaled * F.col("scaled") + reciprocal / F.col("rank"))


def combine(scored: DataFrame, weights: dict[str, float], score: str = "source_score") -> DataFrame:
    """Weighted sum over sources per (query, cid).  A missing source adds nothing and is named."""
    per = scored.groupBy("query", "cid").pivot("source", list(weights)).agg(F.max(score))
    total = sum((w * F.coalesce(F.col(s), F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))
    missing = F.array_compact(F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in weights]))
    return rank_by(per.withColumn("total", F.round(total, 9)).withColumn("missing", missing), "total").select("query", "cid", "total", "missing", "rank")


def margins(ranked: DataFrame, score: str) -> DataFrame:
    """Per query the best score, its margin to the second and its spread to the fifth."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col(score)))
    return ranked.groupBy("query").agg(at(1).alias("top"), (at(1) - F.coalesce(at(2), F.lit(0.0))).alias("margin"), (at(1) - at(5)).alias("spread"))


def ambiguity_gate(ranked: DataFrame, score: str, least: float, margin: float = 0.08) -> DataFrame:
    """Only the first candidate with enough score and margin is matched; a close runner-up calls for review."""
    w = W.partitionBy("query").orderBy("rank")
    nxt = F.coalesce(F.lead(score).over(w), F.lit(0.0))
    return ranked.withColumn("gap", F.col(score) - nxt).withColumn("status", F.when((F.col("rank") > 1) | (F.col(score) < least), "rejected").when(
        F.col("gap") >= margin, "matched").otherwise("needs_review"))


def weighted_anchors(df: DataFrame, group: str, query: str, value: str, probabilities: tuple[float, ...]) -> DataFrame:
    """Quantiles of ``value`` per group where each query weighs one, whatever its number of rows: the value at which the cumulative
    weight first reaches p of the whole."""
    w = F.lit(1.0) / F.count("*").over(W.partitionBy(group, query))
    d = df.withColumn("_w", w).groupBy(group, value).agg(F.sum("_w").alias("_w"))
    cum = F.sum("_w").over(W.partitionBy(group).orderBy(value)) / F.sum("_w").over(W.partitionBy(group))
    d = d.withColumn("_c", cum)
    return d.groupBy(group).agg(*[F.min(F.when(F.col("_c") >= p - 1e-12, F.col(value))).alias(f"p{int(p * 100)}") for p in probabilities])
