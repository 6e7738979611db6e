"""Evidence behind decisions: votes of metrics, gates, kinds of failure, priorities, roll-ups, dictionary relations, drift between parsers."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import col
from tessera.operators.relational import numbered


def metric_votes(baseline: Column, challenger: Column, metrics: Sequence[str]) -> Column:
    """struct(baseline, challenger, available) of two structs' metrics: the larger value has the vote; a null on one side and a difference up to 1e-12 give none."""
    b, c = ([s.getField(m).cast("double") for m in metrics] for s in (baseline, challenger))
    count = lambda marks: sum((F.coalesce(x.cast("long"), F.lit(0).cast("long")) for x in marks), F.lit(0).cast("long"))
    told = [F.abs(x - y) > 1e-12 for x, y in zip(b, c)]
    return F.struct(count([t & (x > y) for t, x, y in zip(told, b, c)]).alias("baseline"), count([t & (y > x) for t, x, y in zip(told, b, c)]).alias("challenger"), count(told).alias("available"))


def pair_support(first: Column, second: Column, there: Column, least: int = 4) -> Column:
    """struct(available, strict_veto, soft_support) of the votes in two modes.  Veto: in both modes at least ``least`` metrics told apart and as many for the baseline.
    Support: in one mode as many for the challenger.  Neither where the pair is not ``there``."""
    told = lambda v, side: (v["available"] >= least) & (v[side] >= least)
    on = F.coalesce(there, F.lit(False))
    return F.struct(on.alias("available"), F.coalesce(on & told(first, "baseline") & told(second, "baseline"), F.lit(False)).alias("strict_veto"),
                    F.coalesce(on & (told(first, "challenger") | told(second, "challenger")), F.lit(False)).alias("soft_support"))


def hypothesis_gate(candidates: DataFrame, query: str, id: str, score: str, tags: str, least: float = 0.5, gap: float = 0.08, signals: int = 2) -> DataFrame:
    """(query, id, score, lead, accepted) of each query's best candidate, of equal scores the smaller id.

    It is accepted with a score of at least ``least`` when it has ``signals`` tags, or leads the next by ``gap``, or has no next.  ``lead`` is null without a next.
    The two best are kept by an aggregate that combines before the shuffle, so a query of many candidates needs no window over them."""
    row = F.struct((-F.col(score)).alias("s"), F.col(id).alias("id"), F.coalesce(F.col(tags), F.lit(0)).alias("tags"))
    rows = candidates.filter(F.col(score).isNotNull()).select(query, row.alias("r"))
    best = rows.groupBy(query).agg(F.min("r").alias("a"))
    second = rows.join(best, query).filter(F.col("r") != F.col("a")).groupBy(query).agg(F.min("r.s").alias("b"))
    out = best.join(second, query, "left").select(query, F.col("a.id").alias(id), (-F.col("a.s")).alias(score), (F.col("b") - F.col("a.s")).alias("lead"), F.col("a.tags").alias("_tags"))
    ok = (F.col(score) >= least) & ((F.col("_tags") >= signals) | F.col("lead").isNull() | (F.round("lead", 9) >= gap))
    return out.select(query, id, score, "lead", ok.alias("accepted"))


def failure_taxonomy(cases: DataFrame, ranked: DataFrame, groups: DataFrame, rival: DataFrame) -> DataFrame:
    """(case, kind, further) of each failed case: its first flag and the rest, in the fixed order of the flags.

    cases: case, truth, suspect, margin.  ranked: case, id, rank (1, 2, ...), pooled, identity, geometry, conflict.  groups: id, grp (ids that are easily confused).
    rival: case, id, rank, score of a source on its own.  TARGET_SUSPECT: marked so.  RETRIEVAL_MISS: the truth is not pooled, else RERANK_ERROR.  LOW_INFORMATION: no margin or one under 0.03.
    SIBLING_AMBIGUITY: the two best share a group.  OCR_CONFLICT: the best is ahead of the truth by more than 0.25 in identity, or the truth's conflict is above 0.3.  GEOMETRY_CONFLICT: ahead by more than 0.25 in geometry.
    SOURCE_CONFLICT: the rival's best is not the truth and leads by more than 0.03.  Fixed values: the bounds."""
    c = cases.select("case", "truth", "suspect", "margin")
    r = ranked.join(c.select("case", "truth"), "case")
    pick = lambda cond, v: F.max(F.when(cond, F.col(v)))
    best, own = F.col("rank") == 1, F.col("id") == F.col("truth")
    told = r.groupBy("case").agg(
        F.max(own & F.col("pooled")).alias("pooled"), pick(best, "id").alias("first"), pick(F.col("rank") == 2, "id").alias("second"),
        *(pick(best, x).alias(f"top_{x}") for x in ("identity", "geometry")), *(pick(own, x).alias(f"own_{x}") for x in ("identity", "geometry", "conflict")))
    pairs = told.filter("second is not null").select("case", "first", "second")
    shared = (pairs.join(groups.select(F.col("id").alias("first"), "grp"), "first").join(groups.select(F.col("id").alias("second"), "grp"), ["second", "grp"])
              .select("case").distinct().withColumn("siblings", F.lit(True)))
    alone = rival.filter("rank <= 2").groupBy("case").agg(pick(best, "id").alias("rival"), (pick(best, "score") - pick(F.col("rank") == 2, "score")).alias("ahead"))
    x = c.join(told, "case", "left").join(shared, "case", "left").join(alone, "case", "left")
    over = lambda e, bound: F.round(e, 9) > bound
    pooled = F.coalesce("pooled", F.lit(False))
    flags = F.array_compact(F.array(
        F.when(F.col("suspect"), "TARGET_SUSPECT"), F.when(pooled, "RERANK_ERROR").otherwise("RETRIEVAL_MISS"),
        F.when(F.col("margin").isNull() | (F.col("margin") < 0.03), "LOW_INFORMATION"), F.when(F.col("siblings"), "SIBLING_AMBIGUITY"),
        F.when(over(F.col("top_identity") - F.col("own_identity"), 0.25) | over(F.col("own_conflict"), 0.3), "OCR_CONFLICT"),
        F.when(over(F.col("top_geometry") - F.col("own_geometry"), 0.25), "GEOMETRY_CONFLICT"),
        F.when((F.col("rival") != F.col("truth")) & over(F.col("ahead"), 0.03), "SOURCE_CONFLICT")))
    return x.select("case", flags.alias("_f")).select("case", F.col("_f")[0].alias("kind"), F.slice("_f", 2, 9).alias("further"))


def diagnostic_priority(df: DataFrame, key: str, score: str, reasons: str, known: str) -> DataFrame:
    """``df`` with diagnostic_rank (known bad rows first, then by falling score, then by key) and priority_level: high for known rows and scores from 0.85, medium from 0.70,
    low from 0.55 or with a reason, else none.  A null score counts as 0, a null mark as not known.  The rank is numbered by ranges of the order."""
    s, k = F.coalesce(F.col(score), F.lit(0.0)), F.coalesce(F.col(known), F.lit(False))
    out = numbered(df.withColumn("_k", ~k).withColumn("_s", -s), ["_k", "_s", key], "diagnostic_rank").drop("_k", "_s")
    some = F.coalesce(F.size(reasons) > 0, F.lit(False))
    return out.withColumn("priority_level", F.when(k | (s >= 0.85), "high").when(s >= 0.70, "medium").when((s >= 0.55) | some, "low").otherwise("none"))


def evidence_quality(observations: DataFrame, regions: DataFrame, passes: DataFrame, by: str) -> DataFrame:
    """The ten measures of recognised text, a row each value of ``by`` in any table.  observations: valid, validity (averaged over valid ones).
    regions: support (at least 2 is supported), consensus, kind (null or "unknown" is no meaning), confidence (high from 0.75).  passes: confidence.  Averages of nothing are 0."""
    mean = lambda c, digits: F.coalesce(F.round(F.avg(F.col(c).cast("decimal(18,6)")), digits).cast("double"), F.lit(0.0))
    o = observations.withColumn("validity", F.when(F.col("valid"), F.col("validity"))).groupBy(by).agg(
        F.count("*").alias("observations"), F.count_if("valid").alias("valid_observations"), mean("validity", 4).alias("average_validity"))
    meant = F.coalesce(F.col("kind") != "unknown", F.lit(False))
    r = regions.groupBy(by).agg(F.count("*").alias("regions"), F.count_if(F.col("support") >= 2).alias("supported_regions"), mean("consensus", 4).alias("average_consensus"),
                                F.count_if(meant).alias("semantic_regions"), F.count_if(meant & (F.col("confidence") >= 0.75)).alias("high_semantic_regions"))
    p = passes.groupBy(by).agg(mean("confidence", 2).alias("average_confidence"))
    x = o.join(r, by, "full").join(p, by, "full").na.fill(0)
    return x.withColumn("rejected_observations", F.col("observations") - F.col("valid_observations"))


def folded(c) -> Column:
    """Compatibility forms folded (NFKC), case folded, white space single.  Spark has no such function, so it runs in Arrow batches; call it on distinct values."""
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))
    return run(col(c))


#: So many distinct tokens are sent to all executors, more meet their items by shuffle.
_FEW = 50_000


def dictionary_relations(df: DataFrame, key: str, raw: str, dictionary: DataFrame, id: str = "id", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(relations key, id, name; unresolved key, raw_token, reason, candidates) of lists of names by comma, semicolon or line.

    A token with exactly one dictionary row of its folded name is related to it, once an item.  Else it is unresolved: ambiguous_normalization with the ids of its rows, sorted, or
    no_exact_dictionary_match.  Blank tokens go, a raw token counts once an item.  Distinct tokens meet the dictionary, so one that many items share is looked up once.  Up to _FEW distinct
    tokens, counted first, go to the items; more of them meet by shuffle.  Spark's own choice, by the size of the files, can send the items."""
    tokens = df.select(key, F.explode(F.split(raw, r"[,;\n]")).alias("raw_token")).filter(F.trim(F.regexp_replace("raw_token", r"\s", " ")) != "").distinct()
    known = dictionary.select(folded(name).alias("_k"), id, name).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct(id, name))).alias("_rows"))
    words = tokens.select("raw_token").distinct()
    found = words.withColumn("_k", folded("raw_token")).join(known.hint("merge"), "_k", "left").select("raw_token", "_rows")
    met = tokens.join(F.broadcast(found) if words.limit(_FEW + 1).count() <= _FEW else found.hint("merge"), "raw_token")
    one = F.coalesce(F.size("_rows") == 1, F.lit(False))
    relations = met.filter(one).select(key, F.col("_rows")[0].alias("r")).select(key, f"r.{id}", f"r.{name}").distinct()
    why = F.when(F.col("_rows").isNull(), "no_exact_dictionary_match").otherwise("ambiguous_normalization")
    ids = F.coalesce(F.transform("_rows", lambda r: r[id]), F.array().cast(f"array<{dict(dictionary.dtypes)[id]}>"))
    return relations, met.filter(~one).select(key, "raw_token", why.alias("reason"), ids.alias("candidates"))


#: What a parser says of a field: struct(matched array, conflicts array, missing array, weight double).
_PARTS = ("matched", "conflicts", "missing", "weight")


def parser_drift(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, item, n): how the features of two parsers differ over the keys of both.  A field is a struct of matched, conflicts, missing (arrays) and weight.

    Items: each of the four (keys where it differs, null equal to null), matches and conflicts before and after (sums of sizes).  Field "*": vectors, and changed (keys with any difference).
    All counts come from one join and one aggregate."""
    both = old.select(key, *(F.col(f).alias(f"o_{f}") for f in fields)).join(new.select(key, *(F.col(f).alias(f"n_{f}") for f in fields)), key)
    differs = {(f, p): ~F.col(f"o_{f}")[p].eqNullSafe(F.col(f"n_{f}")[p]) for f in fields for p in _PARTS}
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0)).cast("long")), F.lit(0))
    counts = {(f, p): F.count_if(d) for (f, p), d in differs.items()}
    for f in fields:
        for side, when in (("o", "before"), ("n", "after")):
            counts[f, f"matches_{when}"], counts[f, f"conflicts_{when}"] = total(F.col(f"{side}_{f}")["matched"]), total(F.col(f"{side}_{f}")["conflicts"])
    counts["*", "vectors"], counts["*", "changed"] = F.count("*"), F.count_if(F.array_contains(F.array(*differs.values()), True))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(i).alias("item"), F.col(f"`{f}.{i}`").alias("n")) for f, i in counts))
    return both.agg(*(c.alias(f"{f}.{i}") for (f, i), c in counts.items())).select(F.inline(rows))
