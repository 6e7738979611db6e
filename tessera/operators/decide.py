"""Final scores, decisions and audits over candidate tables, as columns.  Weights, bounds and names are fixed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERMS = ("geometry", "ocr_attributes", "ocr_identity", "quality", "semantic", "reference_tokens", "reference_phrases", "reference_attribute_match",
         "reference_attribute_conflict", "weak_official_agreement", "reliability_penalty")


def reference_terms(reliability: Column, tokens: Column, phrases: Column, match: Column, conflict: Column, official: Column) -> dict[str, Column]:
    """The six terms that a reference's texts add, weighed by its reliability."""
    return {"reference_tokens": reliability * 0.4 * tokens, "reference_phrases": reliability * 0.2 * phrases, "reference_attribute_match": reliability * 0.2 * match,
            "reference_attribute_conflict": -reliability * 0.2 * conflict, "weak_official_agreement": official * 0.05, "reliability_penalty": (1 - reliability) * -0.1}


def final_score(terms: dict[str, Column], semantic_weight: float = 0.75) -> Column:
    if set(terms) != set(TERMS):
        raise ValueError(f"expected the terms {TERMS}")
    total = F.lit(0.0)
    for t in TERMS:
        total = total + (terms[t] * semantic_weight if t == "semantic" else terms[t])
    return total


def calibrated(score: Column, low: Column, high: Column) -> Column:
    """A source's score between its anchors, clipped to 0 and 1; a missing score is 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / F.greatest(high - low, F.lit(1e-12)))), F.lit(0.0))


def attribute_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], axis: Sequence[str], value: str, confidence: str, least: float = 0.35, high: float = 0.85) -> DataFrame:
    """(keys, match, conflict, axes): over the axes that both documents have, the mean of the best shared value's confidence and the mean conflict,
    which is the least confidence where nothing is shared and all are sure."""
    on = [*keys, *axis]
    x = a.filter(F.col(confidence) >= least).groupBy(*on, value).agg(F.max(confidence).alias("_a"), F.min(confidence).alias("_al"))
    y = b.filter(F.col(confidence) >= least).groupBy(*on, value).agg(F.max(confidence).alias("_b"), F.min(confidence).alias("_bl"))
    shared = x.join(y, [*on, value]).groupBy(*on).agg(F.max(F.least("_a", "_b")).alias("match"))
    low = lambda d, c: d.groupBy(*on).agg(F.min(c).alias(c))
    both = low(x, "_al").join(low(y, "_bl"), on).join(shared, on, "left")
    conflict = F.when(F.col("match").isNull() & (F.least("_al", "_bl") >= high), F.least("_al", "_bl")).otherwise(0.0)
    return both.groupBy(*keys).agg(F.avg(F.coalesce("match", F.lit(0.0))).alias("match"), F.avg(conflict).alias("conflict"), F.count("*").alias("axes"))


def cascade(baseline: Column, proposed: Column, shield: Column, text: Column, strict_veto: Column, rescue: Column, rescue_supports: Column, external: Column, external_soft: Column) -> tuple[Column, Column]:
    """(decision, reason).  A proposal against the baseline falls to the shield or to a text or geometry veto; without one, a single rescued candidate with two
    supports wins, then an external one with soft support."""
    differs = ~proposed.eqNullSafe(baseline)
    veto = (text == "BASELINE_SUPPORT") | strict_veto
    rescued = rescue.isNotNull() & ~veto & (rescue_supports >= 2)
    outside = external.isNotNull() & ~external.eqNullSafe(baseline) & ~veto & external_soft
    reason = (F.when(differs & shield, "SEMANTIC_SHIELD").when(differs & (text == "BASELINE_SUPPORT"), "OCR_BASELINE_VETO").when(differs & strict_veto, "STRICT_GEOMETRY_VETO")
              .when(differs, "KEEP_V3").when(rescued, "CROSS_VIEW_V5").when(outside, "EXTERNAL_V5").otherwise("KEEP_V3"))
    decision = (F.when(reason.isin("SEMANTIC_SHIELD", "OCR_BASELINE_VETO", "STRICT_GEOMETRY_VETO"), baseline).when(reason == "CROSS_VIEW_V5", rescue)
                .when(reason == "EXTERNAL_V5", external).otherwise(proposed))
    return decision, reason


def second_pass_gate(first: Column, second: Column, new_spans: Column, supported: Column) -> tuple[Column, Column]:
    """(adopted, reason): the second pass counts only where it adds a span that the pool supports."""
    adopt = (new_spans > 0) & (supported > 0)
    return F.when(adopt, second).otherwise(first), F.when(adopt, "NEW_SUPPORTED_SPAN").when(new_spans > 0, "NEW_SPAN_WITHOUT_SUPPORT").otherwise("NO_NEW_SPAN")


def audit_priority(style_risk: Column, history_risk: Column, rank_risk: Column, metadata_risk: Column) -> Column:
    return style_risk * 0.58 + history_risk * 0.24 + rank_risk * 0.12 + metadata_risk


def percentile_risk(df: DataFrame, value: str, name: str, buckets: int = 64) -> DataFrame:
    """Adds the share of all values that are at most a row's own; null for a null.  Distinct values are counted and dealt into ``buckets`` ranges at approximate
    quantiles: running sums run inside each range, and what lies below a range is a table of one row per range."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    cuts = counted.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("_q"))
    dealt = counted.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_q", lambda q: q < F.col(value)))).drop("_q")  # one row of quantiles
    ranges = dealt.groupBy("_b").agg(F.sum("_c").alias("_t"))
    below = ranges.select("_b", (F.sum("_t").over(W.orderBy("_b")) - F.col("_t")).alias("_below"), F.sum("_t").over(W.partitionBy(F.lit(1))).alias("_n"))  # a row per range
    run = dealt.withColumn("_s", F.sum("_c").over(W.partitionBy("_b").orderBy(value)))
    share = run.join(F.broadcast(below), "_b").select(value, ((F.col("_below") + F.col("_s")) / F.col("_n")).alias(name))
    return df.join(share, value, "left")


def contribution_deltas(winner: dict[str, Column], truth: dict[str, Column]) -> tuple[Column, Column]:
    """(largest, delta): the term that speaks most for the wrong winner against the truth."""
    d = F.array(*[F.struct(F.round(winner[t] - truth[t], 9).alias("delta"), F.lit(t).alias("term")) for t in sorted(winner, reverse=True)])
    top = F.array_max(d)
    return top["term"], top["delta"]
