"""Similarity joins of words that lose no pair: edit similarity by pieces, Dice by numbered bigrams.

Both compare distinct words only and find candidates by an equality join, so all pairs are never built.  Words that many rows share are
one word here; a caller joins its rows to the pairs afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def _pieces(length: str, edits: str) -> dict[str, str]:
    """Begin and width of piece i when ``length`` letters are cut into edits + 1 nearly equal pieces, the longer ones last."""
    short, extra = f"({length} div ({edits} + 1))", f"({length} % ({edits} + 1))"
    over = f"greatest(0, i - ({edits} + 1 - {extra}))"
    return {"at": f"(i * {short} + {over})", "width": f"({short} + if(i >= {edits} + 1 - {extra}, 1, 0))"}


def _range(low: str, high: str, var: str, body: str) -> str:
    """SQL of an array over low..high, empty where high < low."""
    return f"if(cast({high} as int) < cast({low} as int), array(), transform(sequence(cast({low} as int), cast({high} as int)), {var} -> {body}))"


def edit_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """All pairs (a, b, similarity) of distinct words of ``left.a`` and ``right.b`` with 1 - edits / longer length >= ``least``, which is above 0.5.

    A pair of lengths m and n may differ by d = (1 - least) * max(m, n) edits.  Cut the right word into d + 1 pieces: some piece is
    untouched by the edits, so the left word holds it, and at a place that the edits before and after it can explain (piece i is moved
    by at most i, and by at most d - i from the end).  Pieces and substrings meet by equality on (length, d, i, letters); what
    meets is verified.  Null and empty words meet nothing."""
    if least <= 0.5:
        raise ValueError("words that differ in half of their letters can't be found by pieces; the bound must be above 0.5")
    edits = lambda longer: f"cast(floor({1 - least!r} * {longer} + 1e-9) as int)"
    low, high = f"ceil(n * {least!r} - 1e-9)", f"floor(n / {least!r} + 1e-9)"
    words = lambda df, c, name: df.select(F.col(c).alias(name)).filter(F.length(c) > 0).distinct().withColumn("n", F.length(name))

    p = _pieces("n", "d")
    piece = _range("0", "d", "i", f"named_struct('n', n, 'd', d, 'i', i, 's', substring(b, {p['at']} + 1, {p['width']}))")
    # a word's number of pieces depends on the longer of the two lengths, so it is cut for each number that a partner may bring
    index = (words(right, b, "b").withColumn("d", F.explode(F.expr(f"array_distinct(transform(sequence(cast({low} as int), cast({high} as int)), m -> {edits('greatest(m, n)')}))")))
             .select("b", F.explode(F.expr(piece)).alias("k")))

    p = _pieces("x.m", "x.d")
    shift = (f"greatest({p['at']} - i, {p['at']} + n - x.m - (x.d - i), 0)", f"least({p['at']} + i, {p['at']} + n - x.m + (x.d - i), n - {p['width']})")
    found = _range(*shift, "s", f"named_struct('n', x.m, 'd', x.d, 'i', i, 's', substring(a, s + 1, {p['width']}))")
    probe = (words(left, a, "a").withColumn("x", F.explode(F.expr(_range(low, high, "m", f"named_struct('m', m, 'd', {edits('greatest(m, n)')})")))).filter("abs(x.m - n) <= x.d")
             .select("a", F.explode(F.expr("flatten(" + _range("0", "x.d", "i", found) + ")")).alias("k")))
    pairs = probe.join(index, "k").select("a", "b").distinct()
    return pairs.withColumn("similarity", T.edit_similarity("a", "b")).filter(F.col("similarity") >= least).select(F.col("a").alias(a), F.col("b").alias(b), "similarity")


def dice_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs (a, b, similarity) of distinct words with a similarity above 0: 1 for equal words, 0.82 where one of at least four letters begins the other, else the
    Dice coefficient of their bigrams as multisets.  The n-th occurrence of a bigram meets the n-th one only, so the number of meetings is the
    size of the intersection.  Fixed values: the prefix rule."""
    words = lambda df, c, name: df.select(F.col(c).alias(name)).filter(F.length(c) > 0).distinct()
    numbered = "transform(g, (x, i) -> named_struct('g', x, 'n', size(filter(slice(g, 1, i + 1), y -> y = x))))"

    def grams(df: DataFrame, c: str) -> DataFrame:
        return df.withColumn("g", T.bigrams(c)).select(c, F.explode(F.expr(numbered)).alias("k"))

    x, y = words(left, a, "a"), words(right, b, "b")
    shared = grams(x, "a").join(grams(y, "b"), "k").groupBy("a", "b").agg(F.count("*").alias("n"))
    dice = 2.0 * F.col("n") / (F.length("a") + F.length("b") - 2)
    begins = (F.least(F.length("a"), F.length("b")) >= 4) & (F.startswith("a", "b") | F.startswith("b", "a"))
    near = shared.filter("a <> b").select("a", "b", F.when(begins, 0.82).otherwise(dice).alias("similarity"))
    same = x.join(y, F.col("a") == F.col("b")).select("a", "b", F.lit(1.0).alias("similarity"))
    return near.union(same).select(F.col("a").alias(a), F.col("b").alias(b), "similarity")


def texts_holding(left: DataFrame, right: DataFrame, text: str, part: str) -> DataFrame:
    """All pairs (text, part) of distinct values where the text holds the part anywhere; they meet on the part's first three letters (all of a shorter one)."""
    gram = f"explode(array_distinct(flatten(transform(sequence(1, length({text})), i -> transform(array(1, 2, 3), n -> substring({text}, i, n))))))"
    x = left.select(text).filter(F.length(text) > 0).distinct().withColumn("_gram", F.expr(gram))
    y = right.select(part).filter(F.length(part) > 0).distinct().withColumn("_gram", F.substring(part, 1, 3))
    return x.join(y, "_gram").filter(F.contains(F.col(text), F.col(part))).select(text, part).distinct()


def nearest_words(tokens: DataFrame, dictionary: DataFrame, token: str, word: str, least: float, window: float | None = None) -> DataFrame:
    """(token, word, similarity) of each distinct token that has one: the equal dictionary word, else the most similar one of at least ``least``, of equal ones the
    shorter, then the first by letters.  ``window``: only words whose length differs by at most that share of the token's, rounded up."""
    near = edit_pairs(tokens, dictionary, token, word, least)
    if window is not None:
        near = near.filter(F.abs(F.length(token) - F.length(word)) <= F.greatest(F.lit(1), F.ceil(F.length(token) * window)))
    best = near.groupBy(token).agg(F.min(F.struct((-F.col("similarity")).alias("far"), F.length(word).alias("n"), F.col(word).alias("word"))).alias("_o"))
    return best.select(token, F.col("_o.word").alias(word), (-F.col("_o.far")).alias("similarity"))
