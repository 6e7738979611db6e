"""Entity resolution between catalogs: block, score with capped evidence, rank, gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T


def token_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, df): the number of rows that hold a token."""
    return df.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def idf(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, df, idf) with idf = ln((n + 1) / (df + 1)) + 1."""
    n = df.agg(F.count("*").alias("n"))
    return token_frequency(df, tokens).crossJoin(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def block(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str = "tokens", rare: int | None = None) -> DataFrame:
    """Candidate pairs (left_id, right_id, shared) that share a token; shared counts all common ones.  Rows of equal tokens on the right are
    one candidate set, expanded at the end.  ``rare`` forms pairs on the rarest tokens of the left row only: a bound on the work that gives up pairs."""
    sets = right.select(F.col(right_id), F.array_sort(F.array_distinct(tokens)).alias("_b"))
    distinct = sets.groupBy("_b").agg(F.min(right_id).alias("_rep"))
    lt = left.select(F.col(left_id), F.explode(F.array_distinct(tokens)).alias("token"))
    if rare is not None:
        lt = lt.join(token_frequency(right, tokens), "token").withColumn("_r", F.row_number().over(W.partitionBy(left_id).orderBy("df", "token"))).filter(F.col("_r") <= rare)
    rt = distinct.select("_rep", F.explode("_b").alias("token"))
    pairs = lt.select(left_id, "token").join(rt, "token").select(left_id, "_rep").distinct()
    a = left.select(left_id, F.col(tokens).alias("_a"))
    found = pairs.join(a, left_id).join(distinct, "_rep").select(left_id, "_b", F.size(F.array_intersect("_a", "_b")).alias("shared"))
    return found.join(sets, "_b").select(left_id, right_id, "shared")


def field_state(a: str, b: str) -> Column:
    """missing, equal or conflict, on normalised values."""
    x, y = T.normalize_match_text(a), T.normalize_match_text(b)
    blank = (F.coalesce(F.length(x), F.lit(0)) == 0) | (F.coalesce(F.length(y), F.lit(0)) == 0)
    return F.when(blank, "missing").when(x == y, "equal").otherwise("conflict")


def weighted_cosine(left: DataFrame, right: DataFrame, weights: DataFrame) -> DataFrame:
    """Cosine of sparse maps: left (l, token, w), right (r, token, w), weights (token, idf); unknown tokens weigh 1."""
    def weigh(d: DataFrame, k: str) -> DataFrame:
        return d.join(weights.select("token", "idf"), "token", "left").select(k, "token", (F.col("w") * F.coalesce("idf", F.lit(1.0))).alias("w"))

    a, b = weigh(left, "l"), weigh(right, "r")
    na = a.groupBy("l").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("na"))
    nb = b.groupBy("r").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nb"))
    s = a.join(b.withColumnRenamed("w", "w2"), "token").groupBy("l", "r").agg(F.sum(F.col("w") * F.col("w2")).alias("s"))
    return s.join(na, "l").join(nb, "r").select("l", "r", (F.col("s") / (F.col("na") * F.col("nb"))).alias("cosine"))


def resolve_waterfall(left: DataFrame, right: DataFrame, left_id: str, right_id: str, stages: Sequence[tuple[str, str]]) -> DataFrame:
    """(left_id, right_id, stage): the first stage (name, key column) with exactly one candidate wins; several make the row ambiguous,
    none at all missing."""
    todo, out = left, None
    for name, key in stages:
        cand = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(right_id).alias("_c"), F.min(right_id).alias("_id"))
        j = todo.join(cand, key, "left")
        hit = j.filter("_c = 1").select(left_id, F.col("_id").alias(right_id), F.lit(name).alias("stage"))
        many = j.filter("_c > 1").select(left_id, F.lit(None).cast("long").alias(right_id), F.lit("ambiguous").alias("stage"))
        out = hit.union(many) if out is None else out.union(hit).union(many)
        todo = j.filter("_c is null").select(*left.columns)
    return out.union(todo.select(left_id, F.lit(None).cast("long").alias(right_id), F.lit("missing").alias("stage")))
