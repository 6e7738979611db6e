"""Edit-aware token counts.

A document's text is split once into pre-tokens, the pieces that the tokenizer never merges across.  Leaves of
``LEAF`` pre-tokens hold their characters and token counts, and a segment tree over the leaves holds the sums.  An edit
(start, stop, text) descends the tree to the leaf of its start, re-splits from the last pre-token that could not
have seen the edited characters, and stops as soon as the new split meets an old boundary behind the edit: from there
on the pieces are the old ones.  Only the new pieces are encoded, and only the sums above the touched leaves change.  Trees can be kept as a table
(``token_trees``) and edited again (``edit_trees``) without splitting or encoding the rest of their texts.

Edits apply in order, each to the text the one before left; offsets are code points, cut to the text, and a null text
inserts nothing.  A null document or a null edit list counts as empty.  Rows are independent; repeated rows are counted each, null ids
too; very long texts are counted whole.  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import rows
from tessera.llm.tokenize import default_vocab, encoder

LEAF = 32
#: A leaf that an edit grows beyond this is dealt anew.
SPLIT_AT = 16 * LEAF
#: Pre-tokens whose counts a task remembers.
CACHE = 400_000
#: A pre-token's match looks at most this many characters past its end.
LOOKAHEAD = 2
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"
_SPLIT = regex.compile(public_tokenizers.PATTERN)


class Counter:
    """Token counts of pre-tokens, remembered; ``encoded`` counts the ones asked for."""

    def __init__(self, vocab: str):
        self.encode, self.known = encoder(vocab), {}

    def many(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for p in set(pieces).difference(known):
                known[p] = len(self.encode(p))
            return [known[p] for p in pieces]


class CountTree:
    """The segment tree of one document; ``total`` tokens, ``n_pieces`` pre-tokens."""

    def __init__(self, text: str, count: Counter, kept: tuple[list[int], list[int]] | None = None):
        """``kept``: lengths and counts of the text's pre-tokens from an earlier tree; without them the text is split and encoded."""
        self.text, self.count, self.encoded = text, count, 0
        if kept is None:
            pieces = _SPLIT.findall(text)
            kept = list(map(len, pieces)), count.many(pieces)
        self._build(list(zip(*kept, strict=True)))

    def _build(self, pieces: list[tuple[int, int]]) -> None:
        self.n_pieces = len(pieces)
        n = max(1, -(-len(pieces) // LEAF))
        self.size = 1 << (n - 1).bit_length()
        self.leaves = [pieces[i:i + LEAF] for i in range(0, n * LEAF, LEAF)]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i] = sum(x[0] for x in leaf)
            self.tokens[self.size + i] = sum(x[1] for x in leaf)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def pieces(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of all pre-tokens, to keep the tree."""
        flat = [x for leaf in self.leaves for x in leaf]
        return [x[0] for x in flat], [x[1] for x in flat]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the leaf's first character."""
        i, base = 1, 0
        while i < self.size:
            i *= 2
            if at - base >= self.chars[i]:
                base += self.chars[i]
                i += 1
        leaf = min(i - self.size, len(self.leaves) - 1)
        return leaf, self._start(leaf)

    def _start(self, leaf: int) -> int:
        i, base = leaf + self.size, 0
        while i > 1:
            if i % 2:
                base += self.chars[i - 1]
            i //= 2
        return base

    def _set(self, leaf: int, pieces: list[tuple[int, int]]) -> None:
        self.leaves[leaf] = pieces
        i = leaf + self.size
        self.chars[i], self.tokens[i] = sum(x[0] for x in pieces), sum(x[1] for x in pieces)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        n = len(self.text)
        start = min(max(0, start), n)
        stop = min(max(start, stop), n)
        self.text = self.text[:start] + new + self.text[stop:]
        delta, end = len(new) - (stop - start), start + len(new)
        first, at = self._leaf(max(0, start - LOOKAHEAD))
        kept = []
        for k, (length, tokens) in enumerate(self.leaves[first]):
            if at + length + LOOKAHEAD > start:
                break
            kept.append((length, tokens))
            at += length
        else:
            k = len(self.leaves[first])
        # the old pieces from here on, one at a time
        leaf, old = first, at

        def ahead() -> bool:
            nonlocal leaf, k
            while leaf < len(self.leaves) and k >= len(self.leaves[leaf]):
                leaf, k = leaf + 1, 0
            return leaf < len(self.leaves)

        fresh, met = [], False
        for m in _SPLIT.finditer(self.text, at):
            fresh.append(m.group())
            if m.end() < end:
                continue
            while old < m.end() - delta and ahead():
                old += self.leaves[leaf][k][0]
                k += 1
            if old == m.end() - delta and old >= stop:
                met = True
                break
        if not met:
            leaf, k = len(self.leaves), 0
        counts = self.count.many(fresh)
        self.encoded += len(fresh)
        tail = self.leaves[leaf][k:] if leaf < len(self.leaves) else []
        gone = sum(len(self.leaves[i]) for i in range(first, min(leaf + 1, len(self.leaves))))
        merged = kept + list(zip(map(len, fresh), counts, strict=True)) + tail
        self.n_pieces += len(merged) - gone
        for i in range(first + 1, min(leaf + 1, len(self.leaves))):
            self._set(i, [])
        self._set(first, merged)
        if len(merged) > SPLIT_AT:  # too many for a leaf: as many new pieces as this pay for the new tree
            self._build([x for part in self.leaves for x in part])


@functools.lru_cache(maxsize=2)
def _counter(vocab: str) -> Counter:
    return Counter(vocab)


def _run(vocab: str, keep: bool, known: bool):
    """Counts of (doc_id, text, edits[, lengths, counts]); with ``keep`` the edited text and its tree come along."""
    names = [x.split()[0] for x in (KEPT if keep else RESULT).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocab)
        for b in rows(batches):
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for i, (doc_id, text, edits) in enumerate(zip(*cols[:3], strict=True)):
                tree = CountTree(text or "", count, (cols[3][i] or [], cols[4][i] or []) if known else None)
                before = tree.total
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                row = (doc_id, before, tree.total, tree.n_pieces, tree.encoded)
                out.append((*row, tree.text, *tree.pieces()) if keep else row)
            kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] * keep
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    return run


RESULT = "doc_id long, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long"
KEPT = RESULT + ", text string, lengths array<int>, counts array<int>"


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Column | None = None, vocab: str | None = None) -> DataFrame:
    """``token_counts`` with the text after the edits and its tree (lengths and counts of its pre-tokens): a table to keep."""
    e = edits if edits is not None else F.lit(None)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), e.cast(EDITS).alias("edits"))
    return src.mapInArrow(_run(vocab or default_vocab(), True, False), KEPT)


def edit_trees(trees: DataFrame, edits: Column, vocab: str | None = None) -> DataFrame:
    """The next state of a kept table: only what the edits touch is split and encoded again, whatever the length of the texts."""
    src = trees.select("doc_id", "text", edits.cast(EDITS).alias("edits"), "lengths", "counts")
    return src.mapInArrow(_run(vocab or default_vocab(), True, True), KEPT)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: Column | None = None, vocab: str | None = None) -> DataFrame:
    """Return (doc_id, n_tokens, n_tokens_edited, n_pretokens, n_reencoded), one row per document; ``edits`` is a
    column of EDITS, none if left out."""
    e = edits if edits is not None else F.lit(None)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), e.cast(EDITS).alias("edits"))
    return src.mapInArrow(_run(vocab or default_vocab(), False, False), RESULT)


def revision_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A revision derived from each row itself: a replacement, a deletion and an insertion at places that follow from its id."""
    n, i = F.length(text_col), F.coalesce(F.col(id_col), F.lit(0)).cast("long")
    at = lambda a: F.pmod(i * a + 7, F.greatest(n, F.lit(1))).cast("long")
    edit = lambda s, e, t: F.struct(s.alias("start"), e.alias("stop"), t.alias("text"))
    return F.when(F.col(text_col).isNotNull(), F.array(
        edit(at(7919), at(7919) + 12, F.concat(F.lit(" rev "), i.cast("string"))),
        edit(at(104729), at(104729) + F.pmod(i, F.lit(40)), F.lit("")),
        edit(at(15485863), at(15485863), F.lit("\n\nupdated  text's end"))))
