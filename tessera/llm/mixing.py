"""Mixing sources to target weights, in blocks of words.

1. Each source's documents form one stream of words in the order of (doc_id, text digest, row); it is cut into blocks of a fixed number of words.
   The stream's places come from running sums over ranges of the sorted rows, so no task holds a source.
2. Sources have weights and share the words of the mix by them; a source gets at most ``most`` times its size, and what is over is
   shared again by weight until none is above.
3. The mix is cut into output shards of ``slots`` slots.  Each shard draws how many of its slots each source gets, a multinomial draw
   from a generator seeded by the shard's number, so shards are independent.
4. Running sums of the draws number a source's slots over all shards.  Slots beyond what its target comes to
   go to the sources that drew fewer; every source so gets its target's number of blocks, never more than ``most`` rounds.
5. Slot number q of a source takes, in round q // blocks, the block at place q % blocks of that round's pseudorandom permutation (a keyed
   Feistel network that walks until it is in range), so a round takes every block once.
6. Slots and blocks are joined by (source, block).

A source of fewer than 256 whole blocks has shorter ones, so that a target is met within a hundredth.

Null and empty texts have size 0 and are in no block.  A null source is a source of its own, numbered last; null and repeated ids are
rows like others.  A long text spans many blocks, a block may hold many short ones.  Without any word nothing is taken; an empty
table gives an empty result.  Extra columns are not read.  The sources' table (one row each) comes to the driver and goes to
the tasks; its size is checked, and more than ``most_sources`` raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import ROW, U64, mix, row_keys, running_sums
from tessera.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SLOTS, SEED = 256, 8192, 13


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each ``i`` under the permutation of 0..n-1 that ``key`` names."""
    i, n, key = (np.ascontiguousarray(x).astype(U64) for x in (i, n, key))
    bits = np.zeros(len(n), U64)
    top = np.maximum(n, U64(1)) - U64(1)
    for k in range(64):
        bits += (top >> U64(k)) > 0
    half = np.maximum((bits + U64(1)) // U64(2), U64(1))
    out, todo = i.copy(), np.arange(len(i))
    while len(todo):
        h, k = half[todo], key[todo]
        mask = (U64(1) << h) - U64(1)
        left, right = out[todo] >> h, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix((right + U64(r + 1)) * U64(0x9E3779B97F4A7C15) ^ k) & mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _key(*parts: np.ndarray | int) -> np.ndarray:
    h = np.zeros(1, U64)
    for p in parts:
        h = mix((h + np.asarray(p).astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    return h


def shares(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Targets by weight, none above ``most`` times its size, adding up to all sizes (at least one weight is positive)."""
    total, open_ = sum(sizes), set(range(len(sizes)))
    num, den = total, sum(weights) or 1
    while over := {s for s in open_ if most * sizes[s] * den < num * weights[s]}:
        open_ -= over
        num -= sum(most * sizes[s] for s in over)
        den = sum(weights[s] for s in open_)
    return [num * weights[s] / den if s in open_ else float(most * sizes[s]) for s in range(len(sizes))]


@dataclass
class Recipe:
    """Of each source, by number: words in it and in its target, words a block, blocks, blocks the mix takes."""
    size: np.ndarray
    target: np.ndarray
    width: np.ndarray
    blocks: np.ndarray
    takes: np.ndarray
    slots: int
    seed: int

    @property
    def shards(self) -> int:
        return -(-int(self.takes.sum()) // self.slots)

    def length(self, shard: int) -> int:
        return min(self.slots, int(self.takes.sum()) - shard * self.slots)

    def draw(self, shard: int) -> np.ndarray:
        """The slots of each source in ``shard``."""
        return np.random.default_rng([self.seed, shard]).multinomial(self.length(shard), self.takes / self.takes.sum())


def recipe(sizes: list[int], most: int = 3, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, weights: tuple[int, ...] = (1, 2, 3)) -> Recipe:
    size = np.array(sizes, np.int64)
    target = shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    width = np.clip(size // 256, 1, block)
    blocks = -(-size // width)
    takes = np.array([min(most * int(b), round(t * int(b) / s)) if s else 0 for t, b, s in zip(target, blocks, sizes)], np.int64)
    return Recipe(size, np.array(target), width, blocks, takes, slots, seed)


def _draws(r: Recipe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                n = r.draw(shard)
                s = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), shard)), pa.array(s), pa.array(n[s]), pa.array((np.cumsum(n) - n)[s])], ["shard", "s", "n", "at"])
    return run


def _take(r: Recipe, drawn: np.ndarray, rows: int = 1 << 16):
    """Rows (shard, s, n, at, before) -> one row per slot: shard, slot, s, round, block."""
    over, short = np.maximum(drawn - r.takes, 0), np.maximum(r.takes - drawn, 0)
    over_at, short_at = np.cumsum(over) - over, np.cumsum(short) - short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, s, n, at, before = (b.column(c).to_numpy() for c in ("shard", "s", "n", "at", "before"))
            for i in range(0, len(n), max(1, rows // r.slots)):
                part = slice(i, i + max(1, rows // r.slots))
                own = np.repeat(np.arange(len(n))[part], n[part])
                inner = np.arange(len(own)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                src, q = s[own], before[own] + inner
                spare = q >= r.takes[src]
                place = over_at[src] + q - r.takes[src]
                other = np.clip(np.searchsorted(short_at + short, place, side="right"), 0, len(short) - 1)
                q = np.where(spare, drawn[other] + place - short_at[other], q)
                src = np.where(spare, other, src)
                rnd, k = q // r.blocks[src], q % r.blocks[src]
                length = np.array([r.length(int(x)) for x in shard[part]], np.int64)[own - i]
                slot = permuted(at[own] + inner, length, _key(r.seed, 1, shard[own]))
                block = permuted(k, r.blocks[src], _key(r.seed, 2, src, rnd))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard[own], slot, src, rnd, block)], ["shard", "slot", "s", "round", "block"])
    return run


@dataclass
class Mixture:
    """docs: a row per document (ROW, doc_id, s, size); slots: (shard, slot, s, round, block); pieces: what of which document each block
    holds (s, block, ROW, doc_id, word, n_words, and words on request); recipe: the sources' figures, sources their names by number s."""
    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    recipe: Recipe

    @property
    def rows(self) -> DataFrame:
        """The mix: the pieces of the block in each slot of each shard.  Both sides grow with the documents, so neither is broadcast,
        however small the planner takes the slots to be from the draws they are made of."""
        return self.slots.hint("merge").join(self.pieces, ["s", "block"])


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", words: bool = False, most: int = 3,
            block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, most_sources: int = 1_000_000) -> Mixture:
    """Plan the mix of ``docs``; with ``words`` the pieces hold their words, joined by one space."""
    spark: SparkSession = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("source"))
    keyed = row_keys(src) if words else row_keys(src.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("digest")))
    sized = keyed.select(ROW, "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("digest")) if words else keyed
    sized = materialize(sized, "op13docs")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if (found := by_source.count()) > most_sources:
        raise ValueError(f"{found} sources; at most {most_sources} can be mixed")
    sources = materialize(by_source.withColumn("s", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))).cast("long") - 1), "op13sources")
    r = recipe([x["source_size"] for x in sources.orderBy("s").select("source_size").collect()], most, block, slots, seed)
    known = sources.select("s", F.col("source").alias("__source"))
    docs_s = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
    placed = running_sums(docs_s.filter("size > 0"), "s", ["doc_id", "digest", ROW], "size")
    widths = spark.createDataFrame([(i, int(w)) for i, w in enumerate(r.width)], "s long, width long")
    placed = placed.join(F.broadcast(widths), "s")
    inside = F.expr("transform(sequence(before div width, (before + size - 1) div width), b -> named_struct('block', b, "
                    "'word', greatest(b * width - before, 0L), 'n_words', least((b + 1) * width - before, size) - greatest(b * width - before, 0L)))")
    if words:
        texts = keyed.select(ROW, F.regexp_extract_all("text", F.lit(WORD), 0).alias("w"))
        inside = F.transform(inside, lambda p: p.withField("words", F.array_join(F.slice("w", (p["word"] + 1).cast("int"), p["n_words"].cast("int")), " ")))
        placed = placed.join(texts, ROW)
    pieces = placed.select("s", ROW, "doc_id", F.explode(inside).alias("p")).select("s", ROW, "doc_id", "p.*")
    draws = spark.range(r.shards).mapInArrow(_draws(r), "shard long, s long, n long, at long")
    draws = running_sums(materialize(draws, "op13draws"), "s", ["shard"], "n")
    drawn = np.zeros(len(r.size), np.int64)
    for x in draws.groupBy("s").agg(F.sum("n").alias("n")).collect():  # a row per source
        drawn[x["s"]] = x["n"]
    taken = draws.select("shard", "s", "n", "at", "before").mapInArrow(_take(r, drawn), "shard long, slot long, s long, round long, block long")
    return Mixture(docs_s.select(ROW, "doc_id", "s", "size"), sources, taken, pieces, r)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Return (doc_id, size, source_size, target, taken), one row per document."""
    m = mixture(docs, **options)
    taken = m.rows.groupBy(ROW).agg(F.sum("n_words").alias("taken"))
    figures = docs.sparkSession.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(m.recipe.size, m.recipe.target))], "s long, source_size long, target double")
    return m.docs.join(F.broadcast(figures), "s").join(taken, ROW, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
