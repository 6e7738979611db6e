"""The public byte-level vocabulary, loaded once per Python worker.

``vocab`` is the path of the JSON file of the ``tokenizers`` library or of the equal rank file of ``tiktoken``
(the same merges; the rank file is several times faster).  Both are read where they lie, never copied.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import public_tokenizers


def default_vocab() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def encoder(vocab: str, special: bool = False):
    """A function text -> uint32 array of ids; strings of special tokens are ordinary text, or with ``special`` their own ids,
    as ``Tokenizer.encode(text, add_special_tokens=False)`` has it."""
    ranks = os.path.splitext(vocab)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = _special_tokens(vocab) if special else {}
        enc = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=own)
        return lambda text: enc.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab)
    t.encode_special_tokens = not special
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


def _special_tokens(vocab: str) -> dict[str, int]:
    from tokenizers import Tokenizer

    return {t.content: i for i, t in Tokenizer.from_file(vocab).get_added_tokens_decoder().items() if t.special}


@functools.lru_cache(maxsize=2)
def sentence_ends(vocab: str) -> np.ndarray:
    """For each id, whether a cut behind it ends a sentence: the token ends in . ! ? or a line break."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab)
    ends = np.zeros(t.get_vocab_size() + 2, bool)
    for s, i in t.get_vocab().items():
        ends[i] = s.endswith((".", "!", "?", "Ċ"))
    return ends
