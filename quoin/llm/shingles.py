"""Word and shingle hashes of a column of texts, computed for a whole batch at a time.

Words are runs of characters other than the six ASCII white-space characters, A-Z in lower case. All separators are single
bytes of UTF-8, so words are found in the encoded bytes. A word's 64-bit hash is a polynomial over its bytes, taken from
running sums, and mixed; a shingle's is a mixed linear form of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20_240_501)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C1B
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are hashed at a time, more only where one word is longer.
PART = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverses modulo 2 ** 64 for i < n. Those for a part are kept, longer ones are not."""
    make = lambda n: [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 2**64))]
    if not _powers:
        _powers[:] = make(PART + 1)
    up, down = _powers if n <= PART + 1 else make(n)
    return up, down


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a batch: (the first text's position, hashes of all words in order, each text's bounds in them)."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART, side="right")) - 1)
        at = offsets[first : last + 1] - offsets[first]
        part = raw[offsets[first] : offsets[last]]
        yield first, *(_hash_part(part, at) if len(part) <= PART else _hash_long(part))
        first = last


def _hash_long(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One long text, cut at separators."""
    blanks = np.flatnonzero(SEPARATOR[text])
    found, at = [], 0
    while at < len(text):
        k = int(np.searchsorted(blanks, at + PART, side="right")) - 1
        if k < 0 or blanks[k] < at:  # a word longer than a part
            k += 1
        end = int(blanks[k]) + 1 if k < len(blanks) and len(text) - at > PART else len(text)
        found.append(_hash_part(text[at:end], np.array([0, end - at]))[0])
        at = end
    words = np.concatenate(found)
    return words, np.array([0, len(words)])


def _hash_part(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~SEPARATOR[part]
    if not len(part) or not word.any():
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    edge = np.zeros(len(part) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    up, down = powers(len(part) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[part] * up[: len(part)])])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACE[-1])
    return hashes, np.searchsorted(starts, at)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; runs of different sizes have different hashes."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - size + 1, PLACE[32 + size % 30], np.uint64)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * PLACE[k % 32]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles (int64); with fewer words than ``size``, the whole sequence as one; without words,
    none."""
    for _, words, bounds in word_hashes(texts):
        all_grams = grams(words, size).view(np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(all_grams[a : b - size + 1])
            elif b > a:
                yield grams(words[a:b], b - a).view(np.int64)
            else:
                yield np.zeros(0, np.int64)
