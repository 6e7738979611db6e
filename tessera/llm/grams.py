"""Character n-grams of words, vectorised over many words at once.

A word is framed by a start and an end sign.  An n-gram is packed into one 64-bit integer, sixteen bits a
character (code points beyond the basic plane share the last sixteen values), so n is at most four.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

START, END = 2, 3


def packed(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each predicted character of each word: the word's index, the place in the word (1 the first), and for
    k = 1..order the k-gram that ends there (0 where the word has no such k-gram)."""
    text = chr(START) + (chr(END) + chr(START)).join(words) + chr(END)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where(c > 0xFFEF, np.uint64(0xFFF0) | (c & np.uint64(0xF)), np.maximum(c, np.uint64(1)))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(c)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys, key = [], np.zeros(len(c), np.uint64)
    for k in range(1, order + 1):
        part = np.zeros(len(c), np.uint64)
        part[k - 1:] = c[:len(c) - k + 1] << np.uint64(16 * (k - 1))
        key = key | part
        keys.append(np.where(place >= k - 1, key, np.uint64(0)))
    at = place > 0
    return word[at], place[at], [k[at] for k in keys]


class WordCache:
    """Scores of words, computed for many unknown words at once and remembered up to ``most`` words."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], most: int = 300_000):
        self.score, self.most, self.ids, self.table, self.used = score, most, {}, None, 0

    def learn(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self.ids) if texts else set()
        if self.used + len(new) > self.most:
            self.ids, self.used = {}, 0
            new = set().union(*texts)
        if not new:
            return
        words = list(new)
        got = self.score(words)
        if self.table is None or self.used + len(words) > len(self.table):
            grown = np.zeros((max(self.most, self.used + len(words)), *got.shape[1:]), got.dtype)
            if self.used:
                grown[:self.used] = self.table[:self.used]
            self.table = grown
        self.table[self.used:self.used + len(words)] = got
        self.ids.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)

    def of(self, words: list[str]) -> np.ndarray:
        return self.table[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))]
