"""Token ids of a public byte-level BPE, and pieces of documents no longer than a sequence.

Ids equal those of the ``tokenizers`` library for the same vocabulary. A space followed by a word is always a token
boundary of this vocabulary's pattern, so texts are cut at spaces and each word's ids are kept in a cache. It is bounded in
bytes and emptied when a task ends; only the vocabulary stays with a worker process.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np

#: The special token, which the vocabulary's own library also finds inside texts.
END = "<|endoftext|>"
END_ID = 50256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Bytes that a kept word takes besides its signs and ids: two objects and its place in the table.
ENTRY = 180


class Encoder:
    """text -> little-endian unsigned 32-bit ids. ``cache_bytes`` bounds the memory that kept words take."""

    def __init__(self, vocabulary: str | None = None, cache_bytes: int = 48 << 20):
        import public_tokenizers
        import tiktoken

        with open(vocabulary or default_vocabulary(), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: END_ID})
        self.largest = max(END_ID, *ranks.values())
        self.cache: dict[str, bytes] = {}
        self.cache_bytes, self.held = cache_bytes, 0

    def _plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all"), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._plain(" " + word)
        if len(word) <= 40:
            if self.held >= self.cache_bytes:
                self.forget()
            self.cache[word] = ids
            self.held += ENTRY + len(word) + len(ids)
        return ids

    def forget(self) -> None:
        self.cache.clear()
        self.held = 0

    def encode(self, text: str) -> bytes:
        """Runs of spaces are one token, so such texts are encoded as they are."""
        if "  " in text or text.endswith(" "):
            return self._plain(text)
        first, *words = text.split(" ")
        kept, make = self.cache.get, self._word
        return self._plain(first) + b"".join([kept(w) or make(w) for w in words])


@lru_cache(maxsize=1)
def _encoder(vocabulary: str | None) -> Encoder:
    return Encoder(vocabulary)


@contextmanager
def encoder(vocabulary: str | None = None) -> Iterator[Encoder]:
    """The worker process's encoder for one task. The vocabulary is read once; known words go when the task ends."""
    found = _encoder(vocabulary)
    try:
        yield found
    finally:
        found.forget()


def pieces(ids: bytes, capacity: int, last_id: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of a document's ids and a closing id; only documents over capacity are cut, and the first piece
    may be the shorter one."""
    ids += np.uint32(last_id).astype("<u4").tobytes()
    n = len(ids) // 4
    if n <= capacity:
        yield 0, 0, ids
        return
    head = n % capacity
    cuts = ([0] if head else []) + list(range(head, n, capacity))
    for k, start in enumerate(cuts):
        end = cuts[k + 1] if k + 1 < len(cuts) else n
        yield k, start, ids[4 * start : 4 * end]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
