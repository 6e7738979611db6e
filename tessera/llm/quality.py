"""Quality by perplexity under an interpolated modified Kneser-Ney model of the words of trusted text.

Words are runs without ASCII white space.  A text is its words and an end sign, behind ``order`` - 1 start signs.  The model
is counted by shuffles on 64-bit keys of n-grams and stays a table, sharded by key; nothing of it reaches the driver but four
counts of counts per order:

* the highest order has counts, lower ones the number of distinct grams one longer that end in theirs;
* each order has three discounts, a context's back-off weight is what they free, and below the words all is uniform.

Scoring.  With the log probabilities written as corrections of the next shorter gram,

    log p(w | context) = log p(unknown) + sum over orders of  v(gram) + b(context),
    v(gram) = log P(gram) - b(context) - log P(gram without its first word), 0 if unseen,   b = log back-off weight, 0 if unseen,

so a text's score is a sum over its grams of all orders and (key, v + b) is all that is needed.  The grams counted most often, at most
``head`` of each part below (a table of 12 bytes a gram, broadcast), are summed where the text is read: common words and word pairs never
are rows, so no key of the join is hot.  A bitmap of 2 ** ``bits`` bits, one set for each key of the model, is broadcast too: a gram whose
bit is not set is in no trusted text and adds nothing.  Of the rest documents give rows (row, key, count), each gram of a document once, that
are joined to the model; neither table changes a score, and neither grows with the data.

Disk.  The grams are dealt by key into ``shards`` parts, which are counted, valued and joined one after the other; each reads the texts once more
and has a bitmap of its own.  So on disk are the longest grams once, as counts or as values, and beside them only what one part shuffles.

A text is kept when its perplexity per word is at most the ``quantile`` of trusted texts of its language that the model has
not seen: a fifth of them, by hash of the id, is held out (all languages' where a language holds out fewer than ``least_trusted``).
Languages are the rows' ``lang``; null is a language of its own.

Texts without words (null, empty, white space) have a null perplexity and are rejected.  Without trusted text nothing can be
judged and all texts with words are kept.  Repeated rows and ids are judged each; a null id is never trusted.  A trusted
label counts unless another one of the same id says otherwise.  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm.common import U64, mix, row_keys, word_hashes
from tessera.session import discard, materialize

#: Words of a gram; see the README for what a longer one costs.
ORDER = 2
SHARDS = 4
#: Bound of the broadcast table of a part's common grams.
HEAD = 1 << 20
#: Two to this power are the bits of the broadcast map of the model's keys.
BITS = 27
START, END = U64(0x5BD1E9955BD1E995), U64(0xC2B2AE3D27D4EB4F)
_M1 = U64(0x9E3779B97F4A7C15)
#: Bytes of text worked on at once (one longer text is taken whole).
PIECE = 1 << 21
#: Words of more bytes than this are hashed one by one.
LONG = 256
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
WORD = r"[^\x20\x09-\x0D]+"


def trusted_ids(labels: DataFrame) -> DataFrame:
    return (labels.filter("doc_id is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
            .filter("q = 1 and t = 0").select(F.col("doc_id").cast("long").alias("doc_id")))


def key_of(context: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """The keys of k-grams from those of their contexts and their last words."""
    return mix((mix(context + U64(k)) + word) * _M1)


@F.pandas_udf(LongType())
def pair_key(context: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series(key_of(context.to_numpy(np.int64).view(U64), word.to_numpy(np.int64).view(U64), 2).view(np.int64))


def part_of(k: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each (signed) key, by bits that the bitmap does not use."""
    return (k >> 40) % shards


def part_column(k: str, shards: int) -> Column:
    return F.pmod(F.shiftright(k, 40), F.lit(shards)).cast("int")


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``PIECE`` bytes of the text column."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // PIECE)) + 1).tolist(), b.num_rows]
        for i, j in pairwise(cut):
            if j > i:
                yield b.slice(i, j - i)


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words of a column of texts (null: empty), and the number of words of each text.  A key mixes length and bytes, eight at a time."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    at, size = offsets - offsets[0], int(offsets[-1] - offsets[0])
    data = np.zeros(size + 8, np.uint8)
    if not size:
        return np.zeros(0, U64), np.zeros(len(a), np.int64)
    data[:size] = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    space, edge = _SPACE[data[:size]], np.zeros(size + 1, bool)
    edge[at] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:-1]
    last[:-1] &= space[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    n = np.flatnonzero(last) + 1 - start
    eights = np.ndarray(size + 1, "<u8", data, strides=(1,))
    h = mix((n.astype(U64) * START + (eights[start] & _LOW_BYTES[np.minimum(n, 8)])) * _M1)
    more, done = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(more):
        h[more] = mix((h[more] + (eights[start[more] + done] & _LOW_BYTES[np.minimum(n[more] - done, 8)])) * _M1)
        done += 8
        more = more[n[more] > done]
    long = np.flatnonzero(n > LONG)
    h[long] = word_hashes([data[start[i]:start[i] + n[i]].tobytes() for i in long])
    return h, np.diff(np.searchsorted(start, at))


def gram_keys(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a column of texts: the words of each; and for each sign, start signs included, its text, its place there and for k = 1..order the key of
    the k-gram that ends there (of no meaning at places before k - 1)."""
    words, n = word_keys(texts)
    lead = max(1, order - 1)
    size = n + lead + 1
    ends = np.cumsum(size)
    text, place = np.repeat(np.arange(len(n)), size), np.arange(size.sum()) - np.repeat(ends - size, size)
    h, inner = np.full(len(place), START, U64), place >= lead
    inner[ends - 1] = False
    h[inner] = words
    h[ends - 1] = END
    keys = [h]
    for k in range(2, order + 1):
        key = np.zeros(len(h), U64)
        key[1:] = key_of(keys[-1][:-1], h[1:], k)
        keys.append(key)
    return n, text, place, keys


def _grams(order: int, shards: int, shard: int):
    """(o, k, s, c, n): each gram of the shard that ends in a predicted word, the gram without its first word, its context; n counts the longest ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            texts = b.column(0)
            _, _, place, keys = gram_keys(texts.filter(pc.greater(pc.binary_length(texts), 0)), order)
            inner = np.flatnonzero(place >= max(1, order - 1))
            for k in range(2, order + 1):
                g = keys[k - 1][inner].view(np.int64)
                mine = part_of(g, shards) == shard
                v, at, n = np.unique(g[mine], return_index=True, return_counts=True)
                at = inner[mine][at]
                cols = [np.full(len(v), k, np.int32), v, keys[k - 2][at].view(np.int64), keys[k - 2][at - 1].view(np.int64), n if k == order else np.zeros(len(v), np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["o", "k", "s", "c", "n"])
    return run


def fit(texts: DataFrame, order: int = ORDER, shards: int = SHARDS) -> tuple[DataFrame, float]:
    """The model of a table (text): rows (k, v, n: how often it was counted, shard), and the log probability of an unknown word.  order is at least 2.

    A pair of words is known by its two words' keys, so its own key travels with no row and is computed last."""
    pairs = order == 2
    raws = []
    for shard in range(shards):
        grams = texts.select("text").mapInArrow(_grams(order, shards, shard), "o int, k long, s long, c long, n long")
        raws.append(materialize(grams.groupBy("s", "c").agg(F.sum("n").alias("n")) if pairs else
                                grams.groupBy("o", "k").agg(F.min("s").alias("s"), F.min("c").alias("c"), F.sum("n").alias("n")), "op9raw"))
    raw = reduce(DataFrame.union, raws)
    counts = {order: raw if pairs else raw.filter(F.col("o") == order)}
    for o in range(order - 1, 0, -1):
        cont = counts[o + 1].groupBy(F.col("s").alias("k")).agg(F.count("*").alias("n"))
        counts[o] = materialize(raw.filter(F.col("o") == o).select("k", "s", "c").join(cont, "k") if o > 1 else cont, "op9cont")
    lower, values, longest, unknown, held = None, None, [], 0.0, []
    for o in range(1, order + 1):
        c = counts[o]
        nn = c.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"c{i}") for i in (1, 2, 3, 4)], F.count("*").alias("all")).first()
        d = discounts([nn[f"c{i}"] for i in (1, 2, 3, 4)])
        disc = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        c = c.withColumn("disc", disc)
        if o == 1:
            t = c.agg(F.sum("n").alias("total"), F.sum("disc").alias("off")).first()
            if not t["total"]:
                discard(*raws)
                return values_of(c.select("k", F.lit(0.0).alias("v"), "n"), shards), 0.0
            uniform = t["off"] / t["total"] / (nn["all"] + 1)
            unknown = float(np.log(uniform))
            p = materialize(c.select("k", F.log((F.col("n") - F.col("disc")) / t["total"] + uniform).alias("logp"), "n"), "op9p")
            held.append(p)
            values = p.select("k", (F.col("logp") - unknown).alias("v"), "n")
            lower = p
            continue
        ctx = materialize(c.groupBy("c").agg(F.sum("n").alias("total"), (F.sum("disc") / F.sum("n")).alias("free")), "op9ctx")
        held.append(ctx)
        values = values.union(ctx.select(F.col("c").alias("k"), F.log("free").alias("v"), F.col("total").alias("n")))
        low = lower.select(F.col("k").alias("s"), F.col("logp").alias("low"))
        name = "s" if pairs else "k"
        logp, key = F.log(F.col("own") / F.col("total") + F.col("free") * F.exp("low")).alias("logp"), pair_key("c", "s").alias("k") if pairs else "k"

        def valued(counted: DataFrame) -> DataFrame:
            met = counted.select(*{name, "s"}, "c", (F.col("n") - disc).alias("own")).join(low, "s").select(name, "c", "own", "low").join(ctx, "c")  # noqa: B023
            return met.select(key, logp, "low", F.log("free").alias("b"), "own").select(  # noqa: B023
                "k", "logp", (F.col("logp") - F.col("low") - F.col("b")).alias("v"), F.col("own").alias("n"))

        if o < order:
            lower = materialize(valued(c), "op9both")
            held.append(lower)
            values = values.union(lower.select("k", "v", "n"))
        else:
            # a part's counts go as soon as its values are written
            for shard, part in enumerate(raws):
                part_values = valued(part if pairs else part.filter(F.col("o") == o))
                longest.append(materialize(part_values.select("k", F.col("v").cast("float"), F.col("n").cast("float"), F.lit(shard).alias("shard")), "op9model"))
                discard(part)
    # the longest grams have one value each; the others may have their own and one as a context
    out = reduce(DataFrame.union, longest, values_of(values, shards))
    discard(*held, *[counts[o] for o in range(1, order)])
    return out, unknown


def values_of(values: DataFrame, shards: int) -> DataFrame:
    """One row per key: a gram's own value and its weight as a context add up."""
    return materialize(values.groupBy("k").agg(F.sum("v").cast("float").alias("v"), F.sum("n").cast("float").alias("n")).withColumn("shard", part_column("k", shards)), "op9model")


def discounts(n: list[int]) -> list[float]:
    """The three discounts from the numbers of grams seen 1 to 4 times; half of the count where they are not usable."""
    y = n[0] / max(1, n[0] + 2 * n[1])
    d = [i - (i + 1) * y * n[i] / max(1, n[i - 1]) for i in (1, 2, 3)]
    return [x if 0 < x < i and n[i - 1] else 0.5 * i for i, x in zip((1, 2, 3), d, strict=True)]


def common_grams(model: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and values of the grams counted most often, at most ``head``: all whose count is in the upper classes (eighths of powers of two) that hold no more together."""
    level = F.floor(F.log2(F.greatest("n", F.lit(1.0))) * 8)
    least, held = None, 0
    for r in sorted(model.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > head:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    t = model.filter(level >= least).select("k", "v").toArrow()
    k, v = t["k"].to_numpy(), t["v"].to_numpy()
    k, at = np.unique(k, return_inverse=True)
    return k, np.bincount(at, v, len(k)).astype(np.float32)


def key_bitmap(model: DataFrame, bits: int) -> np.ndarray:
    """Words of 64 bits; bit k mod 2 ** bits is set for each key k of the model."""
    word, mask = (1 << (bits - 6)) - 1, F.expr("shiftleft(1L, cast(k & 63 as int))")
    t = model.groupBy(F.shiftright("k", 6).bitwiseAND(word).alias("w")).agg(F.bit_or(mask).alias("m")).toArrow()
    out = np.zeros(word + 1, np.int64)
    out[t["w"].to_numpy()] = t["m"].to_numpy()
    return out


def _document_grams(order: int, shards: int, shard: int, common):
    """(rid, k, n, s) of the keys of the shard: the distinct grams of each document that are not common but may be in the model (s null), and a row of each document's number of
    words and sum over the common ones (its key, in no model, only spreads such rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = max(1, order - 1)
        known, values, bitmap = common.value
        for b in pieces(batches, 1):
            rid = b.column(0).to_numpy()
            words, text, place, keys = gram_keys(b.column(1), order)
            found = []
            for k, key in enumerate(keys, 1):
                # all grams but the longest also serve as contexts: those of the start signs come along
                key = key.view(np.int64)
                at = np.flatnonzero((part_of(key, shards) == shard) & (place >= (lead if k == order else lead - 1)))
                key = key[at]
                # common grams are in the model, so their bits are set too
                there = (bitmap[(key >> 6) & (len(bitmap) - 1)] >> (key & 63)) & 1 == 1
                found.append((text[at[there]], key[there]))
            d, k = (np.concatenate(x) for x in zip(*found, strict=True))
            own = np.zeros(len(rid))
            if len(known):
                at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                met = known[at] == k
                own = np.bincount(d[met], values[at[met]].astype(np.float64), len(rid))
                d, k = d[~met], k[~met]
            by = np.lexsort((k, d))
            d, k = d[by], k[by]
            at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(k)))
            has = words > 0
            at, n = at[has[d[at]]], n[has[d[at]]]
            ids = rid[has]
            cols = [np.concatenate([rid[d[at]], ids]), np.concatenate([k[at], mix(ids.view(U64)).view(np.int64)]), np.concatenate([n, words[has]])]
            sums = pa.array(np.concatenate([np.zeros(len(at)), own[has]]), mask=np.arange(len(cols[0])) < len(at))
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), sums], ["rid", "k", "n", "s"])
    return run


def score(keyed: DataFrame, model: DataFrame, order: int = ORDER, shards: int = SHARDS, head: int = HEAD, bits: int = BITS) -> DataFrame:
    """(rid, s, m): the sum of the values of each document's grams and the number of its words, from (rid, text); documents without words are absent."""
    parts = []
    for shard in range(shards):
        own = model.filter(F.col("shard") == shard)
        common = keyed.sparkSession.sparkContext.broadcast((*common_grams(own, head), key_bitmap(own, bits)))
        asked = keyed.select("rid", "text").mapInArrow(_document_grams(order, shards, shard, common), "rid long, k long, n long, s double")
        part = asked.join(own.select("k", "v"), "k", "left").groupBy("rid").agg(
            F.sum(F.coalesce("s", F.col("v") * F.col("n"), F.lit(0.0))).alias("s"), F.sum(F.when(F.col("s").isNotNull(), F.col("n"))).alias("m"))
        parts.append(materialize(part, "op9part"))
        common.destroy()
    return reduce(DataFrame.union, parts).groupBy("rid").agg(F.sum("s").alias("s"), F.max("m").alias("m"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", unique: bool = False,
          quantile: float = 0.995, least_trusted: int = 30, held_out: int = 5, order: int = ORDER, shards: int = SHARDS,
          broadcast_ids: int = 1_000_000) -> DataFrame:
    """Return (doc_id, lang, perplexity, threshold, keep), one row per document.  ``unique`` says that the ids are keys of the rows; up to
    ``broadcast_ids`` trusted ids, counted, are broadcast, more are joined by a shuffle."""
    src = docs if unique else row_keys(docs)
    src = src.select(F.col(id_col if unique else "__row").cast("long").alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                     F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ids = materialize(trusted_ids(labels).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0), "op9ids")
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    texts = src.join(ids.filter("not held").select("doc_id"), "doc_id", "left_semi")
    model, unknown = fit(texts, order, shards)
    if unknown == 0.0:
        scored = src.select("doc_id", "lang", F.when(F.regexp_count("text", F.lit(WORD)) > 0, 1.0).alias("perplexity"))
    else:
        logp = F.col("s") + unknown * (F.col("m") + 1)
        scored = src.select("rid", "doc_id", "lang").join(score(src, model, order, shards), "rid", "left").select(
            "doc_id", "lang", F.exp(-logp / (F.col("m") + 1)).alias("perplexity"))
    scored = materialize(scored, "op9score")
    discard(model)
    seen = scored.join(ids.filter("held").select("doc_id"), "doc_id", "left_semi").filter("perplexity is not null")
    q = lambda: F.percentile_approx("perplexity", quantile, 100_000)
    per = seen.groupBy("lang").agg(q().alias("own"), F.count("*").alias("c")).filter(F.col("c") >= least_trusted)
    every = seen.agg(q().alias("all"))
    # one row per language, and one row
    return (scored.join(F.broadcast(per.withColumnRenamed("lang", "_l")), F.col("lang").eqNullSafe(F.col("_l")), "left")
            .crossJoin(F.broadcast(every)).withColumn("threshold", F.coalesce("own", "all"))
            .select("doc_id", "lang", "perplexity", "threshold",
                    (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("keep")))
