"""Text evidence between short texts and catalog rows: kinds of matches, searches, similar items, conflicts, alternate identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import wordjoin as J


def _top(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def lexical_match(a: str, b: str, long_field: Column | bool = False) -> tuple[Column, Column]:
    """(score, kind) of two normalised texts: exact, contains, token-overlap, fuzzy, or null.  Fixed values: the weights and bounds."""
    x, y = F.col(a), F.col(b)
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[\s-]+"), lambda w: F.length(w) >= 2))
    p, q = words(x), words(y)
    shared, n, m = F.size(F.array_intersect(p, q)), F.size(p), F.size(q)
    part = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    contains = x.contains(y) | y.contains(x)
    long_field = F.lit(long_field) if isinstance(long_field, bool) else long_field
    bound = F.when(long_field, 0.18).otherwise(0.4)
    overlap = shared / n * 0.82 + shared / m * 0.18
    edit = T.edit_similarity(x, y)
    usable = (F.least(F.length(x), F.length(y)) >= 4) & (F.greatest(F.length(x), F.length(y)) <= 80) & (edit >= 0.58)

    def pick(out: dict[str, Column]) -> Column:
        return (F.when((F.length(x) == 0) | (F.length(y) == 0), None).when(x == y, out["same"]).when((shared > 0) & ((n == 1) | (m == 1)), out["word"])
                .when(contains, F.when(part >= bound, out["contains"])).when((shared > 0) & (shared / n >= 0.5) & (overlap >= 0.35), out["overlap"]).when(usable, out["fuzzy"]))

    score = pick({"same": F.lit(1.0), "word": F.lit(0.98), "contains": F.least(F.lit(0.96), 0.62 + part * 0.34), "overlap": overlap, "fuzzy": edit * 0.86})
    kind = pick({"same": F.lit("exact"), "word": F.lit("exact"), "contains": F.lit("contains"), "overlap": F.lit("token-overlap"), "fuzzy": F.lit("fuzzy")})
    return score, kind


def keyword_search(queries: DataFrame, items: DataFrame, query: str, keywords: str, item: str, searchable: str, k: int = 5) -> DataFrame:
    """(query, item, score): the k items that hold most of a query's keywords, longer ones counting more.  Items hold words, so
    candidates come from an equality join on words; a keyword inside a longer word is found through the distinct words."""
    words = items.select(item, F.explode(F.array_distinct(F.split(searchable, " "))).alias("_w"))
    keys = queries.select(query, F.explode(F.array_distinct(keywords)).alias("_k"), F.aggregate(F.array_distinct(keywords), F.lit(0), lambda s, x: s + F.length(x)).alias("_n"))
    inside = J.texts_holding(words, keys, "_w", "_k")
    hit = keys.join(inside, "_k").join(words, "_w").select(query, item, "_k", "_n").distinct()
    s = hit.groupBy(query, item).agg((F.sum(F.length("_k")) / F.max("_n")).alias("_c"), F.count("*").alias("hits"))
    s = s.withColumn("score", F.least(F.lit(0.99), 0.3 + F.col("_c") * 0.58 + F.least(F.lit(0.12), F.col("hits") * 0.04)))
    return _top(s, [query], [F.desc(F.round("score", 9)), item], k).select(query, item, "hits", "score")


def tag_match(queries: DataFrame, tags: DataFrame, query: str, text: str, item: str, tag: str, weight: str, k: int = 5) -> DataFrame:
    """(query, item, matched, score): each word of a query's text takes its best tag of an item, by the most similar word of the tag (equal, prefix or Dice) or fully
    where the text holds the whole tag, times the tag's weight; coverage, the strongest and a bonus for several matches make the score.
    Texts and tags are normalised words; distinct words and tags are compared once.  Fixed values: the weights and bounds."""
    word = lambda c, name: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))).alias(name)
    asked = queries.select(query, F.col(text).alias("_x"), word(text, "_t"))
    asked = asked.join(asked.groupBy(query).agg(F.count("*").alias("_n")), query)
    known = tags.select(F.col(tag).alias("_g")).distinct()
    split = known.select("_g", word("_g", "_v"))
    near = J.dice_pairs(asked.select("_t"), split.select("_v"), "_t", "_v").join(split, "_v").select("_t", "_g", "similarity")
    held = J.texts_holding(asked.select("_x"), known, "_x", "_g").join(asked.select("_x", "_t").distinct(), "_x").select("_x", "_t", "_g", F.lit(1.0).alias("similarity"))
    found = asked.join(near, "_t").unionByName(asked.join(held, ["_x", "_t"]))
    bound = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(weight)))
    best = (found.groupBy(query, "_t", "_n", "_g").agg(F.max("similarity").alias("_s")).join(tags.select(item, F.col(tag).alias("_g"), bound.alias("_w")), "_g")
            .groupBy(query, item, "_t", "_n").agg(F.max(F.col("_s") * F.col("_w")).alias("_s")))
    s = best.groupBy(query, item).agg((F.sum("_s") / F.max("_n")).alias("_c"), F.max("_s").alias("_m"), F.count_if(F.round("_s", 9) >= 0.52).alias("matched")).filter("matched > 0")
    s = s.withColumn("score", F.least(F.lit(0.99), F.col("_c") * 0.62 + F.col("_m") * 0.32 + F.least(F.lit(0.12), (F.col("matched") - 1) * 0.06))).filter(F.round("score", 9) >= 0.38)
    return _top(s, [query], [F.desc(F.round("score", 9)), item], k).select(query, item, "matched", "score")


def similar_items(items: DataFrame, item: str, title: str, fields: dict[str, float], base: float = 0.12, title_weight: float = 0.16, most: float = 0.96, k: int = 5) -> DataFrame:
    """(item, other, score): items that share a field, scored by the weights of equal fields and the token overlap of titles."""
    cols = [item, title, *fields]
    a, b = items.select(cols), items.select(*[F.col(c).alias(f"{c}_2") for c in cols])
    pairs = None
    for f in fields:
        p = a.select(item, f).filter(F.col(f).isNotNull()).join(b.select(f"{item}_2", f"{f}_2"), F.col(f) == F.col(f"{f}_2")).select(item, f"{item}_2")
        pairs = p if pairs is None else pairs.union(p)
    j = pairs.filter(F.col(item) != F.col(f"{item}_2")).distinct().join(a, item).join(b, f"{item}_2")
    score = F.lit(base) + T.jaccard(F.split(title, " "), F.split(f"{title}_2", " ")) * title_weight
    for f, w in fields.items():
        score = score + F.coalesce((F.col(f) == F.col(f"{f}_2")).cast("double"), F.lit(0.0)) * w
    j = j.withColumn("score", F.least(F.lit(most), score))
    return _top(j, [item], [F.desc(F.round("score", 9)), f"{item}_2"], k).select(item, F.col(f"{item}_2").alias("other"), "score")


def weighted_fuzzy_search(queries: DataFrame, items: DataFrame, query: str, tokens: str, item: str, fields: dict[str, float], least: float = 0.6, k: int = 5) -> DataFrame:
    """(query, item, score): the best similarity of each query token to a word of each field, weighted by field, averaged over the tokens.
    Distinct words are compared once, in a join that finds every pair of at least ``least``."""
    words = None
    for f, w in fields.items():
        part = items.select(item, F.lit(w).alias("_f"), F.explode(F.array_distinct(F.split(F.lower(f), " "))).alias("_g"))
        words = part if words is None else words.union(part)
    asked = queries.select(query, F.explode(F.array_distinct(tokens)).alias("_t"), F.size(F.array_distinct(tokens)).alias("_n"))
    near = J.edit_pairs(asked, words, "_t", "_g", least).withColumnRenamed("similarity", "_s")
    s = asked.join(near, "_t").join(words, "_g").groupBy(query, item, "_t", "_n").agg(F.max(F.col("_s") * F.col("_f")).alias("_s"))
    s = s.groupBy(query, item).agg((F.sum("_s") / F.max("_n")).alias("score"))
    return _top(s, [query], [F.desc(F.round("score", 9)), item], k).select(query, item, "score")


def pairwise_decision(seen: str, baseline: str, challenger: str) -> Column:
    """Which of two titles (token arrays) the seen tokens support by words only it has; years support none."""
    word = lambda c: F.filter(c, lambda x: ~x.rlike("^(19|20)[0-9]{2}$"))
    only = lambda a, b: F.size(word(F.array_intersect(F.array_except(a, b), seen)))
    b, c = only(baseline, challenger), only(challenger, baseline)
    return F.when((b > 0) & (c == 0), "BASELINE_SUPPORT").when((c > 0) & (b == 0), "CHALLENGER_SUPPORT").otherwise("ABSTAIN")


def reliability(known_bad: Column, producer_conflict: Column, alternate: Column, conflict: Column, usable: Column, duplicate: Column) -> tuple[Column, Column]:
    """(status, reasons) of a reference's texts."""
    reasons = [(known_bad, "known_reference_defect"), (producer_conflict, "visible_producer_contradiction"), (alternate, "ocr_matches_other_catalog_identity_substantially_better"),
               (conflict, "official_visible_attribute_conflict"), (~usable, "insufficient_reference_identity_text"), (duplicate, "duplicate_or_near_duplicate_review")]
    status = (F.when(known_bad, "known_bad_reference").when(producer_conflict | alternate, "suspect_reference").when(conflict, "suspect_metadata")
              .when(~usable | duplicate, "manual_review").otherwise("trusted"))
    return status, F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons]))


def alternate_identity(docs: DataFrame, official: DataFrame, weights: DataFrame, item: str, token: str, confidence: str) -> DataFrame:
    """(item, own, best_id, best, n_matched, substantial): the share of a reference's weighted tokens that its own row explains and the
    row that explains most.  docs: (item, token, confidence), official: (item, token), weights: (token, idf)."""
    w = docs.join(weights, token, "left").select(item, token, (F.coalesce("idf", F.lit(1.0)) * F.col(confidence)).alias("_w"))
    total = w.groupBy(item).agg(F.sum("_w").alias("_n"))
    s = w.join(official.select(F.col(item).alias("_o"), token).distinct(), token).groupBy(item, "_o").agg(F.sum("_w").alias("_s"), F.count("*").alias("_m"))
    s = s.join(total, item).withColumn("_s", F.col("_s") / F.col("_n"))
    order = F.struct(F.round("_s", 9), -F.col("_o"))
    out = s.groupBy(item).agg(F.max(F.when(F.col("_o") == F.col(item), F.col("_s"))).alias("own"), F.max_by(F.struct("_o", "_s", "_m"), order).alias("_b"))
    out = out.select(item, F.coalesce("own", F.lit(0.0)).alias("own"), F.col("_b._o").alias("best_id"), F.col("_b._s").alias("best"), F.col("_b._m").alias("n_matched"))
    far = (F.col("best_id") != F.col(item)) & (F.col("best") >= 0.65) & (F.col("best") - F.col("own") >= 0.30) & (F.col("n_matched") >= 2)
    return out.withColumn("substantial", far)


def metadata_conflicts(observed: DataFrame, expected: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The keys (item, field, axis) that both sides have without a value in common."""
    both = observed.select(*keys, F.col(value).alias("_v")).distinct().join(expected.select(*keys).distinct(), list(keys))
    same = both.join(expected.select(*keys, F.col(value).alias("_v")).distinct(), [*keys, "_v"]).select(*keys).distinct()
    return both.select(*keys).distinct().join(same, list(keys), "left_anti")


def narrow(regions: DataFrame, items: DataFrame, evidence: str, text: str, confidence: str, weight: str, item: str, fields: dict[str, bool], k: int = 10) -> DataFrame:
    """(item, matched, score): catalog rows by the evidence of regions: each piece of evidence takes its best field, the covered share of all evidence
    weight and the strongest match make the score.  fields: name -> whether it is a long one."""
    asked = regions.select(evidence, F.col(text).alias("_a"), (0.55 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence))) * 0.25 + 0.2).alias("_e"), F.col(weight).alias("_w"))
    total = regions.groupBy(evidence).agg(F.max(weight).alias("_w")).agg(F.sum("_w").alias("_t"))
    values = None
    for f, long in fields.items():
        part = items.select(item, F.col(f).alias("_b"), F.lit(long).alias("_l"))
        values = part if values is None else values.union(part)
    word = lambda c: F.explode(F.array_distinct(F.split(c, r"[\s-]+"))).alias("_k")
    texts = asked.select("_a").distinct().select("_a", word("_a")).join(values.select("_b", "_l").distinct().select("_b", "_l", word("_b")), "_k").select("_a", "_b", "_l").distinct()
    score, kind = lexical_match("_a", "_b", F.col("_l"))
    near = texts.withColumn("_s", score).withColumn("kind", kind).filter("_s is not null")
    m = (asked.join(near, "_a").join(values, ["_b", "_l"]).groupBy(item, evidence).agg(F.max(F.col("_s") * F.col("_e")).alias("_s"), F.max("_w").alias("_w")))
    m = m.groupBy(item).agg(F.sum(F.col("_s") * F.col("_w")).alias("_c"), F.max("_s").alias("_m"), F.count("*").alias("matched")).crossJoin(F.broadcast(total))  # one row
    s = m.withColumn("score", F.least(F.lit(1.0), F.col("_c") / F.greatest("_t", F.lit(0.0001)) * 0.88 + F.col("_m") * 0.12))
    return s.orderBy(F.desc(F.round("score", 9)), F.desc("matched"), item).limit(k).select(item, "matched", "score")


def score_all(left: DataFrame, right: DataFrame, score: Column, left_key: Sequence[str], right_key: Sequence[str], k: int, most: int = 2_000) -> DataFrame:
    """The k best right rows of every left row, all of them scored.  A catalog of at most ``most`` rows, counted first, is sent to the left rows; a larger one is dealt into blocks of as many, every
    left row meets each block by its number, and keeps its k best of a block, so no task holds more than a block of the catalog."""
    n = right.count()
    if n <= most:
        return _top(left.join(F.broadcast(right)).withColumn("score", score), left_key, [F.desc("score"), *right_key], k)
    blocks = -(-n // most)
    r = right.withColumn("_block", F.pmod(F.xxhash64(*right_key), F.lit(blocks)))
    pairs = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_block", F.col("_block").cast("long")).join(r, "_block").withColumn("score", score)
    part = _top(pairs, [*left_key, "_block"], [F.desc("score"), *right_key], k).drop("_block")
    return _top(part, left_key, [F.desc("score"), *right_key], k)


def text_hits(words: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, id, token, field, idf, conf): the tokens (id, token, field) of catalog rows that a query (query, token, conf) saw; idf is scaled to 0..1 by the
    number of rows (one row, n)."""
    df = words.groupBy("token").agg(F.count_distinct("id").alias("_d")).crossJoin(F.broadcast(rows))  # one row
    idf = df.select("token", (F.log((F.col("n") + 1) / (F.col("_d") + 1)) / F.log(F.col("n") + 1)).alias("idf"))
    return words.join(queries, "token").join(idf, "token").groupBy("query", "id", "token", "idf", "conf").agg(F.bool_or(F.col("field") == "producer").alias("producer"))


def family_features(hits: DataFrame, best: int = 10) -> DataFrame:
    """(query, id, family, sku, shared_family): seen tokens by what they speak for, each row scaled by its sum (2 at least); family tokens of many rows are damped."""
    top = _top(hits.groupBy("query", "id").agg(F.sum("idf").alias("_s")), ["query"], [F.desc(F.round("_s", 9)), "id"], best).select("query", "id")
    members = hits.join(top, ["query", "id"]).groupBy("query", "token").agg(F.count_distinct("id").alias("_m"))
    h = hits.join(members, ["query", "token"], "left").withColumn("_m", F.coalesce("_m", F.lit(0))).withColumn("_v", F.col("idf") * F.col("conf"))
    family = F.col("producer") | (F.col("_m") >= 2)
    s = h.groupBy("query", "id").agg(F.sum(F.when(family, F.col("_v")).otherwise(0.0)).alias("_f"), F.sum(F.when(family, 0.0).otherwise(F.col("_v"))).alias("_k"),
                                     F.sum(F.when(family, F.col("_v") / F.sqrt(F.greatest(F.lit(1), F.col("_m")))).otherwise(0.0)).alias("_d"))
    total = lambda a: F.greatest(F.lit(2.0), F.col(a) + F.col("_k"))
    return s.select("query", "id", (F.col("_f") / total("_f")).alias("family"), (F.col("_k") / total("_f")).alias("sku"), (F.col("_d") / total("_d")).alias("shared_family"))


def text_candidates(queries: DataFrame, items: DataFrame, query: str, text: str, item: str, title: str, k: int = 20, most: int = 10_000) -> DataFrame:
    """(query, item, strong, exact, year, top3, char, rank): catalog rows by how many of their words a seen text holds nearly (0.82) and exactly, a shared year, the mean
    of the three nearest words and the similarity of the whole texts, compared in that order.  Queries are a stated set of at most ``most`` rows, counted first;
    each meets the distinct words and titles of the catalog once."""
    n = queries.count()
    if n > most:
        raise ValueError(f"{n} queries are too many at once; give them in blocks")
    word = lambda c: F.array_distinct(F.filter(F.split(T.normalize_match_text(c), " "), lambda w: w != ""))
    asked = F.broadcast(queries.select(query, F.explode(word(text)).alias("_q")))
    words = items.select(F.explode(word(title)).alias("_w")).distinct()
    near = words.crossJoin(asked).withColumn("_r", T.ratio("_w", "_q")).groupBy(query, "_w").agg(F.max("_r").alias("_r"))
    whole = items.select(title).distinct().crossJoin(F.broadcast(queries.select(query, text))).withColumn("char", T.ratio(T.normalize_match_text(title), T.normalize_match_text(text))).select(query, title, "char")
    rows = items.select(item, title, F.explode(word(title)).alias("_w")).join(near, "_w").groupBy(query, item, title).agg(
        F.count_if(F.col("_r") >= 0.82).alias("strong"), F.count_if(F.col("_r") >= 0.999).alias("exact"),
        F.max(((F.col("_r") >= 0.999) & F.col("_w").rlike("^(19|20)[0-9]{2}$")).cast("int")).alias("year"), F.slice(F.sort_array(F.collect_list("_r"), False), 1, 3).alias("_t"))
    rows = rows.withColumn("top3", F.aggregate("_t", F.lit(0.0), lambda s, x: s + x) / F.size("_t")).drop("_t").join(whole, [query, title])
    order = W.partitionBy(query).orderBy(F.desc("strong"), F.desc("exact"), F.desc("year"), F.desc("top3"), F.desc("char"), item)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop(title)
