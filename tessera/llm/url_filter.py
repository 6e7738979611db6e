"""URL verdicts: longest fitting rule, else a ratio of two character language models.

Rules name a host and a path prefix; a rule fits its host and all subdomains.  Where several fit, the longest
(host and path together) wins.

Urls without a rule are judged by two smoothed variable-order Markov models over bytes: each context of up to ``ORDER`` - 1 bytes
shrinks its counts towards the next shorter context, down to a uniform start.  A url is two texts, its site (the host without the last label, which
rules go by) and its rest (path and query), digit runs as one 0.  The models learn from the distinct texts of each fold (below), so neither a hot host nor a hot path weighs more than others:

* rejected: texts of urls that a block rule decides, and texts one of whose words is in ``seeds`` (a start list, not a verdict);
* accepted: all other texts.

Both classes are dealt by host into ``FOLDS`` folds, and a url is scored by models that leave out its own fold: no host vouches for or against itself, a
host is rejected because it looks like other rejected ones, whether or not a seed or rule names it.  Only a text with a seed word keeps the rejected texts of
its fold, its own among them, as it is labelled.  The score of a text is the mean over its bytes of
log P(rejected) - log P(accepted), that of a url the greater one of its texts, so an unwanted path at an ordinary host counts.  The cut is calibrated on
distinct urls without a rule, all by out-of-fold scores: midway between the medians of unmarked and of seeded ones, and at least ``spread`` robust
deviations above the first.  Without rejected urls all is allowed.

Counts are hashed into ``CELLS`` cells per order and table, so what is shipped is bounded whatever the input (13 MB).

A null url and one without ``://`` have an empty host and path, no rule and no score, and are allowed, and so is one of an
empty host without path and query.  Repeated rows are judged each; very long urls are scored whole.  An empty table gives an empty
result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import rows
from tessera.session import materialize

ORDER, CELLS, FOLDS = 3, 1 << 15, 8
#: Weight of a context's shorter context.
SHRINK = 2.0
#: Fixed values: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words of a url that start the rejected class.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "farm", "loan", "loans", "pills", "poker", "porn", "spam", "track", "viagra", "xxx")


def parts(url="url"):
    """(host, path, query with its ?) of a url column."""
    rest = F.expr(f"case when instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) else '' end")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return tuple(F.coalesce(x, F.lit("")) for x in (host, path, query))


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the text's index, and per order the cell of the gram that ends there and of its context."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lead = ORDER - 1
    buf = np.frombuffer(b"".join(b"\x01" * lead + x + b"\x02" for x in raw), np.uint8).astype(np.uint64)
    width = np.fromiter(map(len, raw), np.int64, len(raw)) + 1 + lead
    text = np.repeat(np.arange(len(raw)), width)
    at = np.arange(len(buf)) - np.repeat(np.cumsum(width) - width, width) >= lead
    m, s, eight = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - CELLS.bit_length() + 1), np.uint64(8)
    key, grams, contexts = np.zeros(len(buf), np.uint64), [], []
    for k in range(ORDER):
        part = np.zeros(len(buf), np.uint64)
        part[k:] = buf[:len(buf) - k] << np.uint64(8 * k)
        key = key | part
        own = key[at] + (np.uint64(k + 1) << np.uint64(56))
        grams.append((own * m >> s).astype(np.int64))
        contexts.append((((own >> eight) + np.uint64(7)) * m >> s).astype(np.int64))
    return text[at], np.array(grams).reshape(ORDER, -1), np.array(contexts).reshape(ORDER, -1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tbl, cell, n): cell = (order * 2 + is_context) * CELLS + hash."""
    sums: dict[int, np.ndarray] = {}
    for b in rows(batches, 4096):
        tables = b.column(0).to_numpy(zero_copy_only=False)
        text, grams, contexts = cells(b.column(1).to_pylist())
        for c in np.unique(tables):
            mine = tables[text] == c
            s = sums.setdefault(int(c), np.zeros((ORDER, 2, CELLS)))
            for k in range(ORDER):
                s[k, 0] += np.bincount(grams[k][mine], minlength=CELLS)
                s[k, 1] += np.bincount(contexts[k][mine], minlength=CELLS)
    for c, s in sums.items():
        at = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(s.reshape(-1)[at])], ["tbl", "cell", "n"])


def likelihood_difference(texts: list[str], accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """Mean over bytes of log P(rejected model) - log P(accepted model); a model is (order, gram or context, cell)."""
    if not texts:
        return np.empty(0)
    text, grams, contexts = cells(texts)
    logs = []
    for n in (accepted, rejected):
        p = np.full(len(text), 1 / 256)
        for k in range(ORDER):
            p = (n[k, 0][grams[k]] + SHRINK * p) / (n[k, 1][contexts[k]] + SHRINK)
        logs.append(np.log(np.minimum(p, 1.0)))
    return np.bincount(text, logs[1] - logs[0], len(texts)) / np.bincount(text, minlength=len(texts))


def _score(shipped):
    """Adds llr to batches whose first columns are (fold, site, rest, whether the site is labelled, whether the rest is): the greater score of the two texts, null
    where both are empty.  Models leave out the text's fold, but a labelled text keeps the rejected half of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shipped.value
        every = tables.sum(axis=0)
        for b in rows(batches, 4096):
            folds, sites, rests, *own = (b.column(i).to_pylist() for i in range(5))
            asked = [[(f, o, t) for t, o in zip(both, labelled, strict=True) if t] for f, both, labelled in
                     zip(folds, zip(sites, rests, strict=True), zip(*own, strict=True), strict=True)]
            known: dict[tuple[int, bool, str], float] = {}
            for f, o in {(f, o) for x in asked for f, o, _ in x}:
                mine = sorted({t for x in asked for g, p, t in x if (g, p) == (f, o)})
                for i in range(0, len(mine), 512):
                    d = likelihood_difference(mine[i:i + 512], every[0] - tables[f, 0], every[1] - (0 if o else tables[f, 1]))
                    known.update(zip(((f, o, t) for t in mine[i:i + 512]), d.tolist(), strict=True))
            llr = [max(map(known.__getitem__, x), default=None) for x in asked]
            yield pa.RecordBatch.from_arrays([*b.columns[5:], pa.array(llr, pa.float64())], [*b.schema.names[5:], "llr"])
    return run


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
               seeds: Sequence[str] = SEEDS, spread: float = 5.0) -> DataFrame:
    """Return (page_id, host, path, rule, verdict, llr), one row per row; llr is null where a rule decides or there is nothing to score."""
    spark = pages.sparkSession
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path, query = parts()
    src = src.select("page_id", host.alias("host"), path.alias("path"), query.alias("query"))
    # a few rules by contract: their size is the length of the parameter
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p),
                   F.struct(F.lit(len(h) + len(p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("v"))) for v, h, p in rules]
    none = F.lit(None).cast("struct<len:int,rule:string,v:string>")
    src = src.withColumn("_r", F.array_max(F.array_compact(F.array(*fits))) if fits else none)
    short = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    src = src.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.v").alias("ruled"), short(F.regexp_replace("host", r"\.[^.]*$", "")).alias("site"),
                     short(F.concat("path", "query")).alias("rest"), F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"))

    listed = F.array(*[F.lit(s) for s in seeds])
    seeded = {t: F.arrays_overlap(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), listed) if seeds else F.lit(False) for t in ("site", "rest")}
    blocked, free = F.coalesce(F.col("ruled") == "block", F.lit(False)), F.col("ruled").isNull()
    train = materialize(src.select("fold", "site", "rest", (seeded["site"] | seeded["rest"]).alias("seeded"), free.alias("free"),
                                   *[(blocked | x).cast("int").alias(f"bad_{t}") for t, x in seeded.items()]).distinct(), "op10train")
    texts = train.select("fold", F.inline(F.array(*[F.struct(F.col(t).alias("text"), F.col(f"bad_{t}").alias("bad")) for t in seeded])))
    texts = texts.filter("text <> ''").select((F.col("fold") * 2 + F.col("bad")).alias("tbl"), "text").distinct()
    got = texts.mapInArrow(_count, "tbl int, cell int, n double").groupBy("tbl", "cell").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((FOLDS, 2, ORDER, 2, CELLS), np.float32)
    tables.reshape(FOLDS * 2, -1)[got["tbl"], got["cell"]] = got["n"]
    if not tables[:, 1].any():
        return src.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("llr"))

    shipped = spark.sparkContext.broadcast(tables)
    judged = materialize(train.filter("free").select("fold", "site", "rest", F.lit(False).alias("own1"), F.lit(False).alias("own2"), "seeded").mapInArrow(_score(shipped), "seeded boolean, llr double").filter("llr is not null"), "op10judged")
    mid = judged.agg(*[F.percentile_approx(F.when(c, F.col("llr")), 0.5, 100_000) for c in (~F.col("seeded"), F.col("seeded"))]).first()
    accepted = mid[0] or 0.0
    off = judged.filter("not seeded").agg(F.percentile_approx(F.abs(F.col("llr") - accepted), 0.5, 100_000)).first()[0] or 0.0
    cut = max(accepted + spread * 1.4826 * off, (accepted + mid[1]) / 2 if mid[1] is not None else 0.0, 0.0)

    asked = lambda c: F.when(free, F.col(c)).otherwise("").alias(c)
    ask = src.select("fold", asked("site"), asked("rest"), seeded["site"].alias("own1"), seeded["rest"].alias("own2"), "page_id", "host", "path", "rule", "ruled")
    out = ask.mapInArrow(_score(shipped), "page_id long, host string, path string, rule string, ruled string, llr double")
    verdict = F.coalesce("ruled", F.when(F.col("llr") > cut, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "llr")
