"""Token ids of a public byte-level BPE, as little-endian unsigned 32-bit arrays.

Texts go through the rank form of the vocabulary, which gives the same ids several times faster.
Texts that hold the end-of-text string, and texts whose form the rank library refuses (very long
runs of white space), go through the vocabulary's own file.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np

#: The vocabulary's one special string; the vocabulary's own file makes it a single id.
SPECIAL = "<|endoftext|>"


def default_paths() -> tuple[str, str]:
    """(own file, rank file) of the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(own: str | None = None, ranks: str | None = None):
    """A function from a text (null: empty) to its ids as a uint32 array. It is built once in
    each Python worker."""
    import public_tokenizers
    import tiktoken

    if own is None or ranks is None:
        own, ranks = default_paths()
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    plain = fast._core_bpe.encode_ordinary

    @lru_cache(maxsize=1)
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(own)

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if SPECIAL not in text and not (len(text) > 50_000 and _long_blank(text)):
            return np.frombuffer(array("I", plain(text)), np.uint32)
        return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _long_blank(text: str) -> bool:
    """Whether white space fills thousands of characters on end."""
    step = 4096
    return any(text[i : i + step].isspace() for i in range(0, len(text), step))
