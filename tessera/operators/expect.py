"""Constraints as data checks: each returns the rows that break it, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def in_vocabulary(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*words))


def references(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def finite_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    c = F.col(column).cast("double")
    return df.filter(c.isNotNull() & (F.isnan(c) | (c < low) | (c > high)))


def required_when(df: DataFrame, column: str, condition: str) -> DataFrame:
    return df.filter(F.expr(condition) & F.col(column).isNull())


def conflicting(df: DataFrame, key: str, *fields: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*fields))).alias("versions")).filter("versions > 1")


def check(**broken: DataFrame) -> DataFrame:
    """One row per named check with the number of rows that break it."""
    parts = [b.agg(F.count("*").alias("broken")).select(F.lit(n).alias("check"), "broken") for n, b in broken.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
