"""Merges of snapshots: keep-latest upserts, overlays, guarded overrides.  Each returns the new snapshot; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], set_cols: Sequence[str], keep_old: Sequence[str] = (),
                 any_of: Sequence[str] = ()) -> DataFrame:
    """base with delta's rows merged in by key.  ``set_cols`` are overwritten, ``keep_old`` only where the delta has a value,
    ``any_of`` are flags that stay true once true; the other columns stay.  Keys of delta must be unique."""
    d = delta.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"_d_{c}") for c in (*set_cols, *keep_old, *any_of)], F.lit(True).alias("_d"))
    j = base.withColumn("_b", F.lit(True)).join(d, list(keys), "full_outer")

    def value(c: str):
        if c in set_cols:
            return F.when(F.col("_d"), F.col(f"_d_{c}")).otherwise(F.col(c))
        if c in keep_old:
            return F.coalesce(f"_d_{c}", c)
        if c in any_of:
            return F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"_d_{c}"), F.lit(False))
        return F.col(c)

    return j.select(*[value(c).alias(c) for c in base.columns])


def insert_absent(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.unionByName(delta.join(base.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def overlay(base: DataFrame, over: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Effective values: the override where it has one, else the base."""
    o = over.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    j = base.join(o, key, "left")
    return j.select(*[F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def guarded_status(base: DataFrame, plan: DataFrame, key: str, column: str) -> DataFrame:
    """A plan (key, expected, replacement) against the current value: pending, identical or stale."""
    cur = F.col(column)
    return plan.join(base.select(key, column), key, "left").withColumn("status", F.when(cur.eqNullSafe(F.col("expected")), "pending").when(
        cur.eqNullSafe(F.col("replacement")), "identical").otherwise("stale"))


def apply_guarded(base: DataFrame, plan: DataFrame, key: str, column: str) -> DataFrame:
    """The snapshot after the plan; one stale row refuses the whole plan."""
    status = guarded_status(base, plan, key, column)
    stale = status.filter("status = 'stale'").limit(1).count()
    if stale:
        raise ValueError("the plan is stale: a current value is neither the expected nor the replacing one")
    todo = status.filter("status = 'pending'").select(key, F.col("replacement").alias("_new"), F.lit(True).alias("_hit"))
    return base.join(todo, key, "left").select(*[F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in base.columns])


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys of ``new`` that are absent from ``old`` or differ in a column, nulls being equal to nulls."""
    o = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    j = new.join(o, F.col(key) == F.col("_k"), "left")
    differs = F.col("_k").isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return j.filter(differs).select(*new.columns)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, changed or same."""
    o = old.select(key, F.col(value).alias("_old"), F.lit(1).alias("_in_old"))
    n = new.select(key, F.col(value).alias("_new"), F.lit(1).alias("_in_new"))
    return o.join(n, key, "full_outer").select(key, F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(
        F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed").alias("change"))


def reviewed_over_generated(reviewed: DataFrame, generated: DataFrame, key: str) -> DataFrame:
    """Items with a reviewed layer use it alone; the others keep the generated rows."""
    return reviewed.unionByName(generated.join(reviewed.select(key).distinct(), key, "left_anti"))


def carry_forward(prior: DataFrame, current: DataFrame, key: str, decision: str) -> DataFrame:
    """A new list with the decisions taken before; new keys are pending."""
    return current.join(prior.select(key, F.col(decision).alias("_p")), key, "left").withColumn(decision, F.coalesce("_p", F.lit("pending"))).drop("_p")
