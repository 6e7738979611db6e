"""Language of texts and of spans inside them.

Scripts narrow the candidates: a word in a script that only some learned languages use is scored for those
alone.  Each word gets one score per candidate, the log probability of its framed character 1- to
3-grams.  Viterbi over the words, with a penalty for each switch, labels spans of mixed text; a text's
language is the one with most letters in the spans (the first name among equals), and its score is that share.

Learning is one pass that counts hashed n-grams per language inside each task; what is gathered is bounded
by languages x ``BUCKETS`` numbers whatever the size of the corpus.  Rows with a null language are not learned
from.  A text that is null or has no letter is ``und`` with score 0, and so is everything when nothing was learned.

Null and repeated ids are rows like others, repeated rows get equal predictions, very long texts are labelled whole, an empty table
gives an empty result, and extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import rows
from tessera.llm.grams import WordCache, packed

BUCKETS, ORDER, FLUSH = 1 << 16, 3, 50_000
WORD = re.compile(r"[^\W\d_]+")
#: First code points of Unicode script ranges, and the script from there on.
SCRIPTS = ((0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
           (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
           (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
           (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"),
           (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
           (0xFE00, "Other"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"))
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_IDS = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def script_ids(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    return _IDS[np.searchsorted(_STARTS, [ord(w[0]) for w in words], side="right") - 1]


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased.  Fractions, raised and circled digits and numerals are word characters but no letters: they end a run."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ("".join(c if c.isalpha() else " " for c in run)).split()]


def _buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    word, place, keys = packed(words, ORDER)
    w, b = [], []
    for k, key in enumerate(keys):
        ok = (place >= k) & (key != 0)
        h = (key[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        w.append(word[ok])
        b.append(h.astype(np.int64))
    return np.concatenate(w), np.concatenate(b)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n); buckets from BUCKETS on are scripts."""
    held: dict[str, Counter] = {}
    sums: dict[str, np.ndarray] = {}

    def add(lang: str, words: Counter) -> None:
        if words:
            n = np.fromiter(words.values(), np.float64, len(words))
            w, b = _buckets(list(words))
            s = sums.setdefault(lang, np.zeros(BUCKETS + len(_NAMES)))
            s[:BUCKETS] += np.bincount(b, n[w], BUCKETS)
            s[BUCKETS:] += np.bincount(script_ids(list(words)), n, len(_NAMES))
            words.clear()

    for b in rows(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                c = held.setdefault(lang, Counter())
                c.update(words_of(text))
                if len(c) > FLUSH:
                    add(lang, c)
    for lang, c in held.items():
        add(lang, c)
    for lang, s in sums.items():
        at = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(s[at].astype(np.int64))], ["lang", "bucket", "n"])


def fit(texts: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of a table (lang, text): languages, log probabilities [bucket, language], usable [script, language]."""
    got = (texts.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_learn, "lang string, bucket long, n long")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(got["lang"].unique())
    n = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    n[got["bucket"].to_numpy(np.int64), [langs.index(x) for x in got["lang"]]] = got["n"]
    grams, scripts = n[:BUCKETS] + 0.1, n[BUCKETS:]
    usable = scripts >= 0.01 * np.maximum(1, scripts.sum(0))
    usable[~usable.any(axis=1)] = True
    return langs, np.log(grams / grams.sum(0)).astype(np.float32), usable


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The best label per row of ``s`` [words, languages], each change of label costing ``penalty``."""
    n, m = s.shape
    if m == 1:
        return np.zeros(n, np.int64)
    top = int(s.sum(0).argmax())
    # one label is best throughout unless some stretch of words gains more than one switch by leaving it
    gain = np.concatenate([[0.0], np.cumsum(np.delete(s, top, axis=1).max(axis=1) - s[:, top], dtype=np.float64)])
    if (gain - np.minimum.accumulate(gain)).max() <= penalty:
        return np.full(n, top)
    back, v = [], s[0].tolist()
    for row in s[1:].tolist():
        most = max(v)
        floor, b = most - penalty, v.index(most)
        back.append([i if x >= floor else b for i, x in enumerate(v)])
        v = [(x if x >= floor else floor) + y for x, y in zip(v, row, strict=True)]
    at = max(range(m), key=v.__getitem__)
    out = [at]
    for choice in reversed(back):
        at = choice[at]
        out.append(at)
    return np.array(out[::-1])


def _predict(langs: list[str], logp: np.ndarray, usable: np.ndarray, penalty: float):
    def score(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(langs)), np.float32)
        w, b = _buckets(words)
        for j in range(len(langs)):
            out[:, j] = np.bincount(w, logp[b, j], len(words))
        out[~usable[script_ids(words)]] -= 1e4
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(score)
        for b in rows(batches):
            texts = b.column(1).to_pylist()
            words = [words_of(t) if t else [] for t in texts]
            if langs:
                cache.learn(words)
            pred, share, spans = [], [], []
            for text, ws in zip(texts, words, strict=True):
                if not ws or not langs:
                    pred.append("und")
                    share.append(0.0)
                    spans.append([])
                    continue
                path = viterbi(cache.of(ws), penalty)
                letters = np.bincount(path, np.fromiter(map(len, ws), np.int64, len(ws)), len(langs))
                best = int(letters.argmax())
                pred.append(langs[best])
                share.append(float(letters[best] / letters.sum()))
                cut = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
                spans.append([{"first_word": int(a), "lang": langs[path[a]]} for a in cut])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(share, pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("lang", pa.string())])))],
                ["doc_id", "held_out", "lang_pred", "score", "spans"])
    return run


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<first_word: bigint, lang: string>>"


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 12.0) -> DataFrame:
    """Return (doc_id, held_out, lang_pred, score, spans), one row per document; learns from the rows not held out."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.col(lang_col).cast("string").alias("lang")).withColumn("held_out", held_out())
    model = fit(src.filter("not held_out"))
    return src.select("doc_id", "text", "held_out").mapInArrow(_predict(*model, penalty), RESULT)
