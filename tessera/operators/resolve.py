"""Entity resolution with explainable scores: products, reviews and official items against catalog rows.

All functions take pairs that blocking has found, add score, caps and parts as columns, and rank afterwards.  Vocabularies are parameters;
the defaults are fixed values.  Weights, caps and thresholds are fixed values too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

# Words of styles, grapes, and words without meaning for a match.
STYLE = "белое красное розовое сухое полусухое полусладкое сладкое брют экстра игристое".split()
GRAPES = "мерло шардоне рислинг совиньон каберне фран саперави кокур пино нуар гри гриджио мальбек сира шираз мускат алиготе ркацители".split()
STOP = ("российское российский россия вино винный винноградный згу знмп згнмп защищенного географического указания наименования места "
        "происхождения алкогольная продукция напиток").split()
MAKER_STOP = "винодельня завод ооо ао пао зао ип кх".split()


@dataclass(frozen=True)
class Words:
    """The vocabularies of ``score_products``."""
    style: Sequence[str] = field(default_factory=lambda: tuple(STYLE))
    generic: Sequence[str] = field(default_factory=lambda: tuple(GRAPES + STYLE))
    stop: Sequence[str] = field(default_factory=lambda: tuple(STOP))
    maker_stop: Sequence[str] = field(default_factory=lambda: tuple(MAKER_STOP))


def _in(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _tokens(norm: Column, stop: Sequence[str]) -> Column:
    return F.array_except(F.array_distinct(F.filter(F.split(norm, " "), lambda x: F.length(x) > 1)), _in(stop))


def _evidence(a: Column, b: Column) -> Column:
    """1 where two sets meet, -0.5 where both exist and do not, 0 where one is missing."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(F.arrays_overlap(a, b), 1.0).otherwise(-0.5)


def score_products(pairs: DataFrame, name: str, title: str, maker: str, doc: str, words: Words | None = None, best: tuple[str, int, float] | None = None) -> DataFrame:
    """Adds score, caps (names of all that applied) and method.  doc is title, maker, category and region in one text.

    ``best`` = (left key, k, least) keeps only pairs that may be among the k best of their left row with a score of ``least`` or more: the similarity of longest common blocks, which runs in
    Python, is bounded from above by common letters and from below by the longest common word, both built-in, and a pair whose upper bound is under the k-th lower bound of its row is settled without it."""
    v = words or Words()
    base = list(pairs.columns)
    n, t, d = (T.normalize_match_text(F.coalesce(F.col(c), F.lit(""))) for c in (name, title, doc))
    p = pairs.select("*", n.alias("_n"), t.alias("_t"), d.alias("_d"))
    p = p.select("*", _tokens(F.col("_n"), v.stop).alias("_nt"), _tokens(F.col("_t"), v.stop).alias("_tt"), _tokens(F.col("_d"), v.stop).alias("_dt"),
                 F.array_except(_tokens(T.normalize_match_text(F.coalesce(F.col(maker), F.lit(""))), [*v.stop, *v.maker_stop]), _in(v.style)).alias("_mt"),
                 _evidence(T.years(F.coalesce(F.col(name), F.lit(""))), T.years(F.coalesce(F.col(doc), F.lit("")))).alias("_y"),
                 _evidence(*[F.array_intersect(F.array_distinct(F.filter(F.split(c, " "), lambda x: F.length(x) > 1)), _in(v.style)) for c in ("_n", "_d")]).alias("_s"))
    size, known = F.size("_tt"), F.size(F.array_intersect("_tt", _in(v.generic)))
    p = p.withColumn("_g", (size == 0) | ((size <= 2) & (known == size)) | ((size <= 3) & (known >= 2)))
    p = p.withColumn("_m", F.when(F.size("_mt") == 0, 0.0).when(F.arrays_overlap("_mt", "_nt"), 1.0).otherwise(T.jaccard("_nt", "_mt")))
    raw = lambda a, b: (a * 0.25 + b * 0.15 + T.jaccard("_nt", "_dt") * 0.22 + T.substring_score("_n", "_t", F.col("_g")) * 0.12 + F.col("_m") * 0.28
           + F.greatest(F.col("_y"), F.lit(0.0)) * 0.05 + F.greatest(F.col("_s"), F.lit(0.0)) * 0.10 - F.when(F.col("_y") < 0, 0.08).otherwise(0.0) - F.when(F.col("_s") < 0, 0.06).otherwise(0.0))
    weak, bare = F.col("_m") < 0.5, (F.col("_y") <= 0) & (F.col("_s") <= 0)
    caps = [(F.col("_y") < 0, 0.69, "year_mismatch"), (F.col("_s") < 0, 0.74, "style_mismatch"), (F.col("_g") & weak, 0.69, "generic_short_title_without_manufacturer"),
            (F.col("_g") & weak & bare, 0.62, "generic_short_title_without_evidence"), ((F.size("_nt") >= 6) & (F.size("_tt") <= 2) & weak, 0.69, "long_source_short_title"),
            (F.col("_g") & ~weak & bare, 0.82, "generic_short_title_manufacturer_only")]
    if best:
        key, k, floor = best
        bounds = {"_low": raw(T.ratio_floor("_n", "_t"), T.ratio_floor("_n", "_d")), "_high": raw(T.ratio_bound("_n", "_t"), T.ratio_bound("_n", "_d"))}
        for c, score in bounds.items():
            p = _capped(p.withColumn("score", score), caps).withColumnRenamed("score", c).drop("caps")
        place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_low")))
        p = p.withColumn("_place", place).withColumn("_kth", F.max(F.when(F.col("_place") == k, F.col("_low"))).over(W.partitionBy(key)))
        p = p.filter(F.col("_high") >= F.greatest(F.lit(floor), F.coalesce("_kth", F.lit(0.0))))
    p = _capped(p.withColumn("score", raw(T.ratio("_n", "_t"), T.ratio("_n", "_d"))), caps)
    method = F.when(F.col("score") >= 0.90, "high_confidence_text").when(F.col("score") >= 0.78, "medium_confidence_text").when(F.col("score") >= 0.65, "low_confidence_text").otherwise("weak_text")
    return p.withColumn("method", method).select(*base, "score", "caps", "method")


def _capped(p: DataFrame, caps: Sequence[tuple[Column, float, str]]) -> DataFrame:
    """score under all caps that apply, within 0 and 1, to four places; caps their names."""
    least = F.least(F.col("score"), *[F.when(c, top) for c, top, _ in caps], F.lit(1.0))  # least skips nulls
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, _, name in caps]))
    return p.withColumn("caps", names).withColumn("score", F.round(F.greatest(F.lit(0.0), least), 4))


def top_matches(scored: DataFrame, left: str, right: str, least: float = 0.55, k: int = 5) -> DataFrame:
    w = W.partitionBy(left).orderBy(F.desc("score"), right)
    return scored.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---- reviews.  Fixed values: spellings of one word, groups of styles.

SPELLINGS = {"fanagoriya": "fanagoria", "merlot": "merlo", "chardonnay": "shardone", "cabernet": "kaberne", "sauvignon": "sovinon", "pinot": "pino", "noir": "nuar", "riesling": "risling",
             "syrah": "sira", "brut": "bryut", "extra": "ekstra", "red": "krasnoe", "krasnyi": "krasnoe", "white": "beloe", "belyi": "beloe", "rose": "rozovoe", "rozovyi": "rozovoe",
             "dry": "suhoe", "sukhoe": "suhoe", "sukhoi": "suhoe", "sparkling": "igristoe"}
STYLE_GROUPS = {"color": ("krasnoe", "beloe", "rozovoe"), "sugar": ("suhoe", "polusukhoe", "polusladkoe", "sladkoe", "bryut"), "kind": ("igristoe",)}


@dataclass(frozen=True)
class ReviewWords:
    """The vocabularies of ``score_reviews``, in the spelling that tokens have after ``spelled``."""
    generic: Sequence[str]
    grapes: Sequence[str]
    spellings: dict[str, str] = field(default_factory=lambda: dict(SPELLINGS))
    groups: dict[str, Sequence[str]] = field(default_factory=lambda: dict(STYLE_GROUPS))


def spelled(c: Column, spellings: dict[str, str]) -> Column:
    """Distinct Latin-spelled tokens of a text in one spelling, numbers left out."""
    t = F.filter(F.split(T.transliterate(T.normalize_match_text(F.coalesce(c, F.lit("")))), " "), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    return T.canonical(F.array_distinct(t), spellings)


def score_reviews(pairs: DataFrame, words: ReviewWords, title: str = "title", brand: str = "brand", kind: str = "kind", slug: str = "slug", official: str = "official",
                  winery: str = "winery", grapes: str = "grapes", category: str = "category") -> DataFrame:
    """Adds score, caps and status (matched, needs_review, unmatched) of reviewed products against official items."""
    base, s = list(pairs.columns), lambda *cs: spelled(F.concat_ws(" ", *cs), words.spellings)
    generic, known = _in(words.generic), _in(words.grapes)
    minus = F.array_except
    p = pairs.select("*", minus(s(brand), generic).alias("_b"), minus(s(winery), generic).alias("_w"), s(grapes).alias("_g0"), s(title).alias("_t0"), s(official).alias("_o0"), s(slug).alias("_s0"))
    p = p.withColumn("_g", F.array_union(minus("_g0", generic), F.array_intersect("_g0", known))).withColumn("_vocabulary", F.array_union(known, "_g"))
    p = p.withColumn("_t", minus("_t0", "_b")).withColumn("_o", minus("_o0", "_w"))
    p = p.withColumn("_name", minus(F.array_union("_s0", "_o"), F.col("_w")))
    p = p.withColumn("_si", minus(minus("_t", generic), F.col("_vocabulary"))).withColumn("_ci", minus(minus("_name", generic), F.col("_vocabulary")))
    p = p.withColumn("_identity", T.jaccard("_si", "_ci")).withColumn("_winery", T.jaccard("_b", "_w")).withColumn("_sg", F.array_intersect("_t0", "_vocabulary"))
    p = p.withColumn("_grape", T.jaccard("_sg", "_g"))
    sorted_text = lambda c: F.array_join(F.array_sort(minus(c, generic)), " ")
    left, right = s(title, kind), s(official, slug, category)
    agree, conflict = F.lit(False), F.lit(False)
    for group in words.groups.values():
        a, b = F.array_sort(F.array_intersect(left, _in(group))), F.array_sort(F.array_intersect(right, _in(group)))
        both = (F.size(a) > 0) & (F.size(b) > 0)
        agree, conflict = agree | (both & (a == b)), conflict | (both & (a != b))
    p = p.withColumn("_conflict", conflict).withColumn("_style", F.when(conflict, -1.0).when(agree, 1.0).otherwise(0.0))
    ya, yb = T.years(F.coalesce(F.col(title), F.lit(""))), T.years(F.concat_ws(" ", official, slug))
    p = p.withColumn("_year", F.when((F.size(ya) == 0) | (F.size(yb) == 0), 0).when(F.arrays_overlap(ya, yb), 1).otherwise(-1))
    raw = (F.col("_identity") * 0.55 + T.ratio(sorted_text("_t"), sorted_text("_o")) * 0.15 + T.jaccard(minus("_t", generic), minus("_name", generic)) * 0.10 + F.col("_winery") * 0.10
           + F.col("_grape") * 0.05 + F.greatest(F.col("_style"), F.lit(0.0)) * 0.05 + F.when((F.col("_year") == 1) & (F.col("_identity") == 1), 0.03).otherwise(0.0)
           - F.when(F.col("_year") == -1, 0.12).otherwise(0.0) - F.when(F.col("_conflict"), 0.20).otherwise(0.0))
    empty = (F.size("_si") == 0) | (F.size("_ci") == 0)
    differ = ~empty & ((F.size(minus("_si", "_ci")) > 0) | (F.size(minus("_ci", "_si")) > 0))
    other_winery = (F.size("_b") > 0) & (F.size("_w") > 0) & (F.col("_winery") == 0)
    caps = [(empty, 0.49, "missing_discriminative_identity"), (differ & ~F.arrays_overlap("_si", "_ci"), 0.49, "conflicting_product_identity"),
            (differ & F.arrays_overlap("_si", "_ci"), 0.79, "conflicting_product_identity"), (other_winery, 0.49, "winery_conflict"), (~other_winery & (F.col("_winery") < 1), 0.79, "winery_not_confirmed"),
            ((F.size("_sg") > 0) & (F.size("_g") > 0) & (F.col("_grape") == 0), 0.49, "grape_conflict"), (F.col("_conflict"), 0.49, "style_conflict"), (F.col("_year") == -1, 0.79, "year_conflict")]
    p = _capped(p.withColumn("score", raw), caps)
    status = F.when(F.col("score") >= 0.85, "matched").when(F.col("score") >= 0.55, "needs_review").otherwise("unmatched")
    return p.select(*base, "score", "caps", status.alias("status"), F.col("_identity").alias("identity"), F.col("_grape").alias("grape_score"))


def match_reviews(scored: DataFrame, left: str, right: str, k: int = 5, margin: float = 0.08) -> DataFrame:
    """Rank, and keep matched only for a first row at least ``margin`` ahead of the second."""
    w = W.partitionBy(left).orderBy(F.desc("score"), right)
    r = scored.withColumn("rank", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    gap = F.max(F.when(F.col("rank") == 1, F.round(F.col("score") - F.col("_next"), 4))).over(W.partitionBy(left))
    unsure = (F.col("rank") > 1) | (F.coalesce(gap, F.lit(1.0)) < margin)
    return r.withColumn("status", F.when((F.col("status") == "matched") & unsure, "needs_review").otherwise(F.col("status"))).filter(F.col("rank") <= k).drop("_next")


def discovery_status(best: DataFrame, titles: str = "n_titles") -> DataFrame:
    """Adds discovery (strong_candidate, review_candidate, reject) and reasons to each first-ranked review match."""
    why = F.array_compact(F.array(F.when(F.col("identity") != 1, F.lit("distinctive_identity_not_exact")), F.when(F.col("grape_score") != 1, F.lit("grape_not_exact")),
                                  F.when(F.col(titles) > 1, F.lit("conflicting_discovered_titles"))))
    d = F.when(F.col("status") == "unmatched", "reject").when((F.col("status") == "matched") & (F.size(why) == 0), "strong_candidate").otherwise("review_candidate")
    return best.withColumn("reasons", why).withColumn("discovery", d)


# ---- official items against known ones

def identity_candidates(pairs: DataFrame, title_equal: Column, contained: Column, same_maker: Column, similarity: Column, support: Column, hard: Column, strong_media: Column, evidence: Column) -> DataFrame:
    """Adds automatic, plausible and confidence to pairs and drops those without any sign of identity.  support: number of fields that agree; hard: array of
    contradicting fields; strong_media, evidence: whether strong or any media evidence exists."""
    # a shared picture does not rescue a title that nothing confirms
    hard = F.when(strong_media & ~(title_equal | contained), F.array_union(hard, F.array(F.lit("title_unconfirmed")))).otherwise(hard)
    p = pairs.select("*", title_equal.alias("_eq"), contained.alias("_in"), same_maker.alias("_mk"), similarity.alias("similarity"), support.alias("_su"), hard.alias("contradictions"),
                     strong_media.alias("strong_media"), evidence.alias("_ev"))
    c, free = F.col, F.size("contradictions") == 0
    no = lambda *fields: ~F.arrays_overlap("contradictions", _in(fields))
    match = c("_eq") & c("_mk") & (c("_su") >= 2) & free
    automatic = free & ((c("strong_media") & c("_mk") & (c("_su") >= 2)) | match)
    likely = c("_mk") & (c("_eq") | ((c("similarity") >= 0.8) & no("year", "category")))
    plausible = c("strong_media") | match | likely | (c("_mk") & (c("_in") | (c("similarity") >= 0.62)) & no("year", "category", "grapes"))
    p = p.withColumn("automatic", automatic).withColumn("plausible", plausible).filter(c("plausible") | c("_ev") | c("_eq") | (c("similarity") >= 0.45))
    return p.withColumn("confidence", F.when(c("automatic"), "high").when(c("plausible"), "medium").otherwise("low")).drop("_eq", "_in", "_mk", "_su")


def identity_plan(items: DataFrame, candidates: DataFrame, item: str, other: str, collisions: DataFrame) -> DataFrame:
    """(item, class, selected): re_slug for one automatic candidate and no other plausible one, true_new without any evidence,
    manual_review else; an item whose key collides is always reviewed."""
    g = candidates.groupBy(item).agg(F.count_if("plausible").alias("_p"), F.count_if(F.col("plausible") & F.col("automatic")).alias("_a"), F.count_if("_ev").alias("_e"),
                                     F.min(F.when(F.col("plausible") & F.col("automatic"), F.col(other))).alias("_s"))
    j = items.select(item).join(g, item, "left").join(collisions.select(item).distinct().withColumn("_c", F.lit(True)), item, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    free = F.col("_c").isNull()
    kind = F.when((n("_p") == 1) & (n("_a") == 1) & free, "re_slug").when((n("_p") == 0) & (n("_e") == 0) & free, "true_new").otherwise("manual_review")
    return j.select(item, kind.alias("class"), F.when(kind == "re_slug", F.col("_s")).alias("selected"))
