"""Exact Jaccard self-join of word-shingle sets with index skipping and answer skipping.

Two texts link when 100 * |intersection| >= 75 * |union| of their sets of distinct five-word shingles.
The join is exact (over 64-bit shingle hashes) and works in these steps:

1. Copies collapse: a set is known by a 128-bit digest, gets a number, and one row stands for all its copies.
2. A sampled part of the shingle space (by hash, the same part for all sets) drops every set that
   cannot have a partner: of a set's n shingles a partner lacks at most n/4, so at least
   (sampled - n/4) of its sampled shingles must occur in another set.  This is a bound, not a guess.
3. The remaining sets are ordered rarest shingle first.  Shingles of one set only take the first
   positions and are never indexed.  Index lists hold the prefix (set, size, position); a list is cut
   into blocks by size class and by sixteenths of the position, and a probe joins only with the blocks in which a
   set can lie that has enough shingles left behind its position, so all other blocks are skipped unread.
4. Answer skipping: every set in a list is compared with the list's leader only.  Two other sets share
   at most what both share with the leader and, outside it, shingles that other sets hold too; so most
   pairs follow from computed answers, and pairs already in one component need none.  What is left is verified.

Nulls and texts without words have an empty set, link with nothing and are their own component.  A row
whose doc_id is null links with nothing and gets a null component.  Repeated rows and repeated ids are
separate rows.  Very long texts are taken whole.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, ascii_words, lists, rows, shingles
from tessera.operators.graph import connected_components
from tessera.session import discard, materialize

#: Share of the shingle space that step 2 looks at, in 1/1024.
SAMPLED = 320
#: Up to this many ids of sets with a possible partner are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _in_sample(h: np.ndarray, share: int) -> np.ndarray:
    return h[(h >> U64(20)) % U64(1024) < U64(share)]


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signatures(share: int):
    """One row per document: size, digest, and the sampled shingles where this task meets the set first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in rows(batches):
            n, d0, d1, toks, first = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(ascii_words(text)) if text else np.empty(0, U64)
                dig = _digest(s)
                n.append(len(s))
                d0.append(dig[0])
                d1.append(dig[1])
                new = bool(len(s)) and dig not in seen
                if new:
                    seen.add(dig)
                first.append(new)
                toks.append(_in_sample(s, share).view(np.int64) if new else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()),
                 lists(toks, np.int64, first)], ["doc_id", "n", "d0", "d1", "tok"])
    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows(batches):
        toks = [shingles(ascii_words(t)).view(np.int64) for t in b.column(1).to_pylist()]
        d0, d1 = zip(*(_digest(t.view(U64)) for t in toks), strict=True) if toks else ((), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), lists(toks, np.int64)], ["rep", "d0", "d1", "set"])


def _need(a: str, b: str) -> str:
    """Least overlap with which sets of sizes a and b link: 100 o >= 75 (a + b - o)."""
    return f"ceil(75 * ({a} + {b}) / 175)"


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SAMPLED) -> DataFrame:
    """Return (doc_id, n_shingles, component_id), one row per row of ``docs``."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    full = materialize(src.mapInArrow(_signatures(share), "doc_id long, n long, d0 long, d1 long, tok array<long>"), "op4sig")
    sigs = materialize(full.select("doc_id", "n", "d0", "d1"), "op4doc")
    groups = materialize(sigs.filter("n > 0 and doc_id is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"))
                         .withColumn("id", F.monotonically_increasing_id()), "op4groups")  # written, so the numbers stay
    reps = materialize(groups.join(_alive(full), ["d0", "d1"]).select("rep", "d0", "d1", "id"), "op4rep")
    discard(full)

    ids = reps.select(F.col("rep").alias("doc_id")).distinct()
    if reps.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = src.join(ids, "doc_id", "left_semi").filter("text is not null")
    sets = materialize(
        texts.mapInArrow(_full_sets, "rep long, d0 long, d1 long, set array<long>").join(reps, ["rep", "d0", "d1"])
        .select("id", "set", F.size("set").cast("long").alias("n")), "op4set")
    links = materialize(_links(sets.dropDuplicates(["id"])), "op4link")
    discard(sets)
    comp = connected_components(links, "a", "b")

    # a component is named by the least doc_id of its sets
    member = groups.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    name = member.groupBy("component").agg(F.min("rep").alias("cid"))
    named = member.join(name, "component").select("d0", "d1", "cid")
    out = sigs.select("doc_id", "n", "d0", "d1").join(named, ["d0", "d1"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("cid", "doc_id")).alias("component_id"))


def _alive(full: DataFrame) -> DataFrame:
    """(d0, d1) of the sets that can have a partner, by the sampled shingles that two different sets hold."""
    tok = full.filter("tok is not null").select("d0", F.explode("tok").alias("h"))
    shared = tok.groupBy("h").agg(F.min("d0").alias("a"), F.max("d0").alias("b")).filter("a <> b").select("h")
    hits = tok.join(shared, "h").groupBy("d0").agg(F.count("*").alias("c"))
    sizes = full.filter("tok is not null").groupBy("d0", "d1").agg(F.max("n").alias("n"), F.max(F.size("tok")).alias("m"))
    return (sizes.join(hits, "d0", "left")
            .filter(F.coalesce("c", F.lit(0)) >= F.col("m") - F.floor(F.col("n") / 4)).select("d0", "d1"))


#: The blocks (size class, sixteenth) of an index list that can hold a partner of a set of size n at position pos: one of size m in the class
#: with m (1 - q / 16) and n - pos shingles left, both of which reach 3 (n + m) / 7, up to the rounding of sizes.
_BLOCKS = """filter(flatten(transform(array(size_class - 1, size_class, size_class + 1), c -> transform(sequence(0, 4), q -> named_struct('c', c, 'q', bigint(q))))),
    b -> greatest(power(4 / 3D, b.c), n * 3 / 7D / (4 / 7D - b.q / 16D)) <= least(power(4 / 3D, b.c + 1), (n - pos) * 7 / 3D - n) + 1)"""


def _links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that join exactly the sets that the links join; sets: (id, set, n)."""
    tok = sets.select("id", F.explode("set").alias("h"))
    freq = tok.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = (tok.join(freq, "h").groupBy("id")
               .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
               .join(sets.select("id", "n"), "id")
               .withColumn("u", F.col("n") - F.size("common"))
               .filter("100 * (n - u) >= 75 * n")
               .withColumn("width", F.expr("n - ceil(75 * n / 100) + 1 - u")).filter("width > 0"))
    post = ordered.select("id", "n", "u", F.posexplode(F.expr("slice(common, 1, int(width))")).alias("j", "t")).select(
        F.col("t.h").alias("h"), "id", "n", "u", (F.col("u") + F.col("j")).alias("pos"))
    post = materialize(post, "op4post")

    # answers with the leader of each list: the set with fewest shingles of its own, the one most of its copies stem from
    lead = post.groupBy("h").agg(F.min(F.struct("u", "id", "n", "pos")).alias("l"), F.count("*").alias("k")).filter("k > 1")
    star = (post.join(lead, "h").filter("id <> l.id")
            .filter(f"least(n - pos, l.n - l.pos) >= {_need('n', 'l.n')}")
            .select("id", F.col("l.id").alias("leader")).distinct())
    known = materialize(_overlaps(star.select(F.col("id").alias("a"), F.col("leader").alias("b")), sets), "op4star")
    linked = known.filter(f"o >= {_need('na', 'nb')}").select("a", "b")
    comp = connected_components(linked, "a", "b")

    # pairs across components that the leader's answers leave open
    p = (post.join(lead.select("h", F.col("l.id").alias("leader")), "h")
         .join(known.select(F.col("a").alias("id"), F.col("b").alias("leader"), "o"), ["id", "leader"], "left")
         .join(comp.withColumnRenamed("node", "id"), "id", "left")
         .withColumn("component", F.coalesce("component", "id")))
    mixed = p.groupBy("h").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
    p = p.join(mixed, "h").withColumn("size_class", F.floor(F.log("n") / F.log(F.lit(4 / 3)))).withColumn("sixteenth", F.floor(16 * F.col("pos") / F.col("n")))
    p = materialize(p.withColumn("main", F.col("component") == F.col("c0")), "op4open")
    left = p.filter("not main").withColumn("block", F.explode(F.expr(_BLOCKS)))
    rest = (left.alias("x").join(p.alias("y"), F.expr(
        "x.h = y.h and x.block.c = y.size_class and x.block.q = y.sixteenth and x.component <> y.component and (y.main or x.id < y.id) "
        "and x.id <> x.leader and y.id <> y.leader "
        f"and least(x.n - x.pos, y.n - y.pos) >= {_need('x.n', 'y.n')} "
        f"and coalesce(least(x.o, y.o) + least(x.n - x.u - x.o, y.n - y.u - y.o), x.n + y.n) >= {_need('x.n', 'y.n')}"))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    more = _overlaps(rest, sets).filter(f"o >= {_need('na', 'nb')}").select("a", "b")
    return linked.union(more)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, o): sizes and exact overlap of each pair."""
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"), F.col("n").alias("na"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"), F.col("n").alias("nb"))
    return (pairs.join(a, "a").join(b, "b")
            .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o")))
