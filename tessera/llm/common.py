"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize

U64 = np.uint64
_M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers."""
    h = (h ^ (h >> U64(30))) * _M2
    return h ^ (h >> U64(27))


def ascii_words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at runs of space and \\x09-\\x0D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def shingles(words: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words count as one shingle, none as none."""
    n = len(words)
    if not n:
        return np.empty(0, U64)
    w = word_hashes(words)
    width = min(k, n)
    h = np.full(n - width + 1, U64(width), U64)
    for j in range(width):
        h = mix((h + w[j:n - width + 1 + j]) * _M1)
    return np.unique(h)


def rows(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``most`` rows, to bound what is held at once."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def lists(parts: list[np.ndarray], dtype, valid: list[bool] | None = None) -> pa.Array:
    """An Arrow list column from one array per row; rows with valid[i] False are null."""
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = pa.array(np.concatenate(parts) if parts else np.empty(0, dtype))
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    mask = None if valid is None else pa.array([not v for v in valid])
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=mask)


#: The name of the key that ``row_keys`` adds.
ROW = "__row"


def row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row that stays the same whenever it is read: its file and its place there.
    What is not plainly read from Parquet is written first."""
    try:
        assert docs._jdf.queryExecution().analyzed().children().isEmpty()
        docs.select("_metadata.file_path", "_metadata.row_index")
    except (AnalysisException, AssertionError):
        docs = materialize(docs, "rows")
    placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    # one row per file, not per document
    files = docs.select(F.col("_metadata.file_path").alias("__file")).distinct()
    files = materialize(files.withColumn("__no", F.row_number().over(W.orderBy("__file")).cast("long")), "files")
    key = F.shiftleft("__no", 40).bitwiseOR(F.col("__at"))
    return placed.join(F.broadcast(files), "__file").select(*docs.columns, key.alias(ROW))


def running_sums(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``df`` with the sum ``before`` of ``value`` over the earlier rows of the same ``group`` (a long column) by ``order``, which must tell rows apart.
    Rows are dealt out by ranges of (group, order): each task adds up its own, and the tasks' totals, a row for each task and group
    in it, give where each begins; so a group may hold any share of the rows."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, v = b.column(group).to_numpy(), b.column(value).to_numpy()
            sums = np.cumsum(v) - v
            first = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1])
            start = np.repeat(sums[first], np.diff(np.concatenate([first, [len(g)]])))
            before = sums - start
            if g[0] == last:
                before[:first[1] if len(first) > 1 else len(g)] += carry
            last, carry = g[-1], int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), part)), pa.array(before)], [*names, "__part", "__before"])

    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    local = materialize(ranged.mapInArrow(run, f"{kinds}, __part long, __before long"), "sums")
    totals = local.groupBy("__part", group).agg(F.sum(value).alias("__sum"))
    base = totals.select("__part", group, F.coalesce(F.sum("__sum").over(W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return local.join(F.broadcast(base), ["__part", group]).select(*names, (F.col("__base") + F.col("__before")).alias("before"))
