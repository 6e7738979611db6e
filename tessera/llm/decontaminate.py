"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern of kept and ignored token positions.  All windows of the test items and of the
documents are hashed under each mask over the kept positions only, so a substituted token at an ignored
position does not spoil the hit.  Hits are joined on (mask, hash), give an alignment (item, shift), and
around each alignment the two token sequences are compared position by position: it counts when at least
``least_share`` of the aligned item tokens agree over at least ``least_tokens`` agreeing tokens
(all of a shorter item).  Items shorter than the shortest mask are hashed whole and found where all their
tokens stand in a row.

Each row of the test set is an item of its own, whatever its item_id: ids may repeat (question and answers,
translations), and a null id is reported as null.

The test set is small by nature: up to ``broadcast_windows`` hashed windows are shipped to the tasks, after
counting them.  A larger test set is joined by a shuffle on the hashes instead, with the same result.

Tokens are lower-cased runs between white space without leading and trailing punctuation.  Null and empty
texts match nothing.  Repeated rows are judged one by one.  An empty test set leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, ascii_words, mix, rows, word_hashes
from tessera.session import materialize

#: Kept (1) and ignored (0) positions of each window.
MASKS = ("11110111", "1101101011", "110010110101", "11100100111")
SHORT = min(map(len, MASKS))
_STRIP = b""" .,;:!?"'()[]{}<>*#$%&|-_=+/\\~`^@"""
_M1 = U64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(_STRIP) for x in ascii_words(text)) if w] if text else []


def window_hashes(w: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window of the token hashes ``w``, over the kept positions of ``mask``."""
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.full(n, U64(sum(1 << i for i, c in enumerate(mask) if c == "1")), U64)
    for j, c in enumerate(mask):
        if c == "1":
            h = mix((h + w[j:j + n]) * _M1)
    return h


def item_masks(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` tokens; one that no mask fits is hashed whole."""
    return MASKS if n >= SHORT else ("1" * n,) if n else ()


def whole(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first of the places ``at`` of each hash: a short item agrees in full wherever it stands."""
    return at[np.sort(np.unique(h[at], return_index=True)[1])]


def agreement(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(agreeing, aligned) tokens when item token i lies on document token i + shift."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    return int((doc[lo + shift:hi + shift] == item[lo:hi]).sum()), hi - lo


def best_run(doc: np.ndarray, item: np.ndarray, shift: int, least_share: float) -> tuple[int, int]:
    """The longest stretch of the alignment that starts and ends in agreement and agrees in at least
    ``least_share`` of its positions: (agreeing, length)."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[lo + shift:hi + shift] == item[lo:hi]
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    score = np.concatenate([[0.0], np.cumsum(same - least_share)])
    best = (0, 0)
    for k, a in enumerate(at):  # items are short: a benchmark question, not a corpus
        ok = at[k:][score[at[k:] + 1] - score[a] >= -1e-9]
        if len(ok) and ok[-1] - a + 1 > best[1]:
            best = (int(same[a:ok[-1] + 1].sum()), int(ok[-1] - a + 1))
    return best


def _judge(items: list[tuple[int | None, np.ndarray]], least_tokens: int, least_share: float):
    def run(w: np.ndarray, hits: set[tuple[int, int]]):
        """The best verified item of a document: (item_id, agreeing, aligned) or None."""
        best = None
        for i, shift in sorted(hits):
            item_id, t = items[i]
            same, length = best_run(w, t, shift, least_share)
            if same >= min(least_tokens, len(t)) and (best is None or same > best[1]):
                best = (item_id, same, length)
        return best
    return run


def _scan(items: list[tuple[int | None, np.ndarray]], least_tokens: int, least_share: float):
    """Look document windows up in the shipped table of item windows, verify, and give one row per document."""
    table: dict[int, list[tuple[int, int]]] = {}
    for i, (_, t) in enumerate(items):
        for mask in item_masks(len(t)):
            for pos, h in enumerate(window_hashes(t, mask).tolist()):
                table.setdefault(h, []).append((i, pos))
    short = ["1" * n for n in sorted({len(t) for _, t in items if len(t) < SHORT})]
    keys = np.fromiter(table, U64, len(table))
    bits = np.zeros(1 << 22, bool)
    bits[(keys & U64((1 << 22) - 1)).astype(np.int64)] = True
    judge = _judge(items, least_tokens, least_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            out = []
            for text in b.column(1).to_pylist():
                w = word_hashes(tokens(text))
                hits = set()
                for mask in (*MASKS, *short):
                    h = window_hashes(w, mask)
                    at = np.flatnonzero(bits[(h & U64((1 << 22) - 1)).astype(np.int64)])
                    for p in (at if len(mask) >= SHORT else whole(h, at)).tolist():
                        hits.update((i, p - q) for i, q in table.get(int(h[p]), ()))
                out.append(judge(w, hits))
            yield _answers(b.column(0), out)
    return run


def _answers(ids: pa.Array, out: list) -> pa.RecordBatch:
    item, same, length = zip(*(x or (None, 0, 0) for x in out), strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([x is not None for x in out], pa.bool_()), pa.array(item, pa.int64()),
         pa.array(same, pa.int64()), pa.array(length, pa.int64())],
        ["doc_id", "contaminated", "item_id", "n_same", "n_aligned"])


RESULT = "doc_id long, contaminated boolean, item_id long, n_same long, n_aligned long"


def _windows(short: list[str] | None):
    """(rid, h, pos) of all windows: of items by their own masks, or of documents where ``short`` lists the masks of short items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 64):
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = word_hashes(tokens(text))
                hs, at = [], []
                for mask in item_masks(len(w)) if short is None else (*MASKS, *short):
                    h = window_hashes(w, mask)
                    at.append(np.arange(len(h)) if len(mask) >= SHORT else whole(h, np.arange(len(h))))
                    hs.append(h[at[-1]])
                if sum(map(len, hs)):
                    pos = np.concatenate(at)
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(pos), pa.int64()), pa.array(np.concatenate(hs).view(np.int64)),
                                                      pa.array(pos, pa.int64())], ["rid", "h", "pos"])
    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token counts below SHORT that occur."""
    seen = {n for b in batches for t in b.column(0).to_pylist() if 0 < (n := len(tokens(t))) < SHORT}
    yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], ["n"])


def _verify(least_tokens: int, least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 64):
            out = []
            for text, item_id, item, shifts in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                t = word_hashes(tokens(item))
                out.append(_judge([(item_id, t)], least_tokens, least_share)(word_hashes(tokens(text)), {(0, s) for s in shifts}))
            a = _answers(b.column(0), out)
            yield pa.RecordBatch.from_arrays([*a.columns, b.column(3)], [*a.schema.names, "item"])
    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", least_tokens: int = 12, least_share: float = 0.75,
                  broadcast_windows: int = 200_000) -> DataFrame:
    """Return (doc_id, contaminated, item_id, n_same, n_aligned), one row per document; the item is the one
    with most agreeing tokens, the first in the order of ids (null last) and texts among equals."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    test = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item")) \
        .filter("item is not null")
    n = test.select(F.sum(F.size(F.split("item", r"\s+"))) * len(MASKS)).first()[0] or 0
    if n <= broadcast_windows:
        got = [(r["item_id"], word_hashes(tokens(r["item"]))) for r in test.orderBy(F.asc_nulls_last("item_id"), "item").collect()]
        return src.mapInArrow(_scan([x for x in got if len(x[1])], least_tokens, least_share), RESULT)

    keyed = materialize(src.withColumn("rid", F.expr("uuid()")), "op3docs").withColumn("rid", F.xxhash64("rid"))
    test = materialize(test.withColumn("key", F.monotonically_increasing_id()), "op3items")
    found = test.select("item").mapInArrow(_lengths, "n long").distinct().collect()  # fewer than SHORT rows
    short = ["1" * n for n in sorted(r["n"] for r in found)]
    mine = keyed.select("rid", "text").mapInArrow(_windows(short), "rid long, h long, pos long")
    theirs = test.select(F.col("key").alias("rid"), F.col("item").alias("text")).mapInArrow(_windows(None), "rid long, h long, pos long") \
        .select("h", F.col("rid").alias("key"), F.col("pos").alias("q"))
    hits = (mine.join(theirs, "h").select("rid", "key", (F.col("pos") - F.col("q")).alias("shift")).distinct()
            .groupBy("rid", "key").agg(F.collect_list("shift").alias("shifts")))
    order = F.struct(-F.col("n_same"), F.col("item_id").isNull(), "item_id", "item")
    checked = (hits.join(keyed.select("rid", "text"), "rid").join(test, "key")
               .select("rid", "text", "item_id", "item", "shifts")
               .mapInArrow(_verify(least_tokens, least_share), f"{RESULT}, item string").filter("contaminated")
               .groupBy("doc_id").agg(F.min_by(F.struct("item_id", "n_same", "n_aligned"), order).alias("b")))
    return keyed.select("doc_id", "rid").join(checked.withColumnRenamed("doc_id", "rid"), "rid", "left").select(
        "doc_id", F.col("b").isNotNull().alias("contaminated"), "b.item_id",
        F.coalesce("b.n_same", F.lit(0)).alias("n_same"), F.coalesce("b.n_aligned", F.lit(0)).alias("n_aligned"))
