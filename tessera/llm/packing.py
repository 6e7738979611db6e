"""Order-preserving packing by dynamic programming.

The token ids of the documents of a partition form one stream in row order.  A sequence is a window of at
most ``width`` ids of that stream; windows are cut at document ends, sentence ends or, where a
stretch has none for a whole window, at width.  The cuts minimise padding plus a penalty for
cutting a document (at a sentence end) or a sentence:

    cost(j) = penalty(j) + min over i in reach of cost(i) + padding(i, j)

Padding is width - (j - i), so the minimum runs over cost(i) + position(i) in a sliding window: a
monotone queue gives it in constant time per cut.  A window whose length is a power of two has no padding;
these few lengths are extra transitions.

The stream is solved in stretches of about ``stretch`` ids; the last window of a stretch stays open and is carried
into the next one, so memory is bounded and cuts do not depend on the ends of Arrow batches for more
than one window.  There is no shuffle: a partition is packed where it is read, and sequence ids hold the
number of the partition.  Ids are those of the vocabulary's own library, strings of special tokens in a text included.
Null and empty texts are the single end id, an empty table gives an empty result.  Repeated rows are packed each; very long texts are
encoded whole and cut.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import rows
from tessera.llm.tokenize import default_vocab, encoder, sentence_ends

WIDTH, END_ID = 2048, 1
#: Penalties in tokens for a cut inside a document at a sentence end, and for one inside a sentence.
IN_DOCUMENT, IN_SENTENCE = 2.0, 24.0


def best_cuts(at: list[int], penalty: list[float], width: int) -> list[int]:
    """at: increasing cut positions, the first 0, none more than ``width`` after the one before it.
    Return the chosen positions, first and last included, of least total cost."""
    n = len(at)
    cost, back = [0.0] * n, [0] * n
    queue: deque[int] = deque()
    powers = [1 << e for e in range((width).bit_length()) if 1 << e <= width]
    where = {p: i for i, p in enumerate(at)}
    for j in range(1, n):
        key = cost[j - 1] + at[j - 1]
        while queue and cost[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j - 1)
        while at[j] - at[queue[0]] > width:
            queue.popleft()
        i = queue[0]
        best = cost[i] + at[i] + width - at[j]
        for p in powers:
            k = where.get(at[j] - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + penalty[j], i
    out, j = [at[-1]], n - 1
    while j:
        j = back[j]
        out.append(at[j])
    return out[::-1]


class _Stream:
    """The open end of a partition's stream: pieces (doc_id, start, ids, doc_tokens) and their cut positions."""

    def __init__(self, ends: np.ndarray, width: int):
        self.ends, self.width, self.pieces, self.length = ends, width, [], 0
        self.sequence = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.pieces.append((doc_id, 0, ids, len(ids)))
        self.length += len(ids)

    def cuts(self) -> tuple[list[int], list[float]]:
        at, pen = [np.zeros(1, np.int64)], [np.zeros(1)]
        base = 0
        for _, _, ids, _ in self.pieces:
            inner = np.flatnonzero(self.ends[ids[:-1]]) + 1
            at += [inner + base, np.array([base + len(ids)])]
            pen += [np.full(len(inner), IN_DOCUMENT), np.zeros(1)]
            base += len(ids)
        a, p = np.concatenate(at), np.concatenate(pen)
        far = np.flatnonzero(np.diff(a) > self.width)
        if len(far):  # a stretch without a sentence end for more than a window: cut it at every quarter window
            step = max(1, self.width // 4)
            more = np.concatenate([np.arange(a[i] + step, a[i + 1], step) for i in far])
            a, p = np.concatenate([a, more]), np.concatenate([p, np.full(len(more), IN_SENTENCE)])
            order = np.argsort(a, kind="stable")
            a, p = a[order], p[order]
        return a.tolist(), p.tolist()

    def flush(self, last: bool) -> list[tuple]:
        """Rows of all closed sequences; the last window stays open unless the stream ends."""
        if not self.length:
            return []
        chosen = best_cuts(*self.cuts(), self.width)
        if not last:
            chosen = chosen[:-1]
        out, rest, base, c = [], [], 0, 0
        for doc_id, start, ids, total in self.pieces:
            lo = base
            while lo < base + len(ids):
                c = bisect_left(chosen, lo + 1)
                if c == len(chosen):
                    rest.append((doc_id, start + lo - base, ids[lo - base:], total))
                    break
                hi = min(chosen[c], base + len(ids))
                part = ids[lo - base:hi - base]
                out.append((doc_id, start + lo - base, hi - lo, zlib.crc32(np.ascontiguousarray(part, "<u4").tobytes()), total,
                            self.sequence + c - 1, lo - chosen[c - 1]))
                lo = hi
            base += len(ids)
        self.sequence += len(chosen) - 1
        self.pieces, self.length = rest, sum(len(x[2]) for x in rest)
        return out


RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(vocab: str, width: int, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab, special=True)
        stream = _Stream(sentence_ends(vocab), width)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in RESULT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

        end = np.array([END_ID], np.uint32)
        for b in rows(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                stream.add(doc_id, np.concatenate([encode(text), end]) if text else end)
                if stream.length >= stretch and (out := stream.flush(False)):
                    yield batch(out)
        if out := stream.flush(True):
            yield batch(out)
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, width: int = WIDTH,
         stretch: int = 400_000) -> DataFrame:
    """Return one row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_pack(vocab or default_vocab(), width, stretch), RESULT)
