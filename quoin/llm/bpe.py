"""Byte-level BPE: texts to token ids and back, with the ids of the ``tokenizers`` library for the same vocabulary file.

A text is cut at special tokens, then into words by the vocabulary's pattern. A word starts as a doubly linked list of byte
symbols; a priority queue holds the merges that its neighbours allow, by rank and then by place, and entries whose symbols
have changed since are skipped when they come up. Decoding puts the vocabulary's strings together.

A space before anything but white space always begins a word of this pattern, so texts are cut there first, and what
stands between two such spaces is looked up as a whole. The tables of what came before are bounded in bytes.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import bounded_batches, table

#: Fixed value: how the vocabulary's pre-tokenizer cuts words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that doesn't begin a word.
ODD = r" (?:\s|\Z)"
#: Bytes that a kept word takes besides its signs and ids, and the longest word that is kept.
ENTRY, LONGEST = 180, 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's strings: visible ones for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}


class Bpe:
    """A vocabulary with its merges. ``cache_bytes`` bounds the memory that kept texts take."""

    def __init__(self, vocabulary: str | None = None, cache_bytes: int = 112 << 20):
        if vocabulary is None:
            import public_tokenizers

            vocabulary = public_tokenizers.path("byte_bpe_50k.json")
        with open(vocabulary, encoding="utf-8") as lines:
            held = json.load(lines)
        letters, ids = byte_letters(), held["model"]["vocab"]
        self.strings = {k: bytes(letters[c] for c in token) for token, k in ids.items()}
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.strings |= {k: token.encode() for token, k in self.special.items()}
        # The same strings end to end; the last number stands for ids that the vocabulary hasn't.
        ordered = [self.strings.get(k, b"") for k in range(max(self.strings) + 2)]
        self.lengths = np.array([len(x) for x in ordered], np.int64)
        self.letters, self.starts = np.frombuffer(b"".join(ordered), np.uint8), np.cumsum(self.lengths) - self.lengths
        self.first = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = (x if isinstance(x, list) else x.split(" ") for x in held["model"]["merges"])
        #: An id's bits; by left id and right id in one number the merge's rank and new id in one number.
        self.bits = max(self.strings).bit_length()
        self.pairs = {ids[a] << self.bits | ids[b]: rank << self.bits | ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split
        self.words, self.odd, self.at_spaces = regex.compile(WORDS).findall, regex.compile(ODD).search, regex.compile(r" (?=\S)").split
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_bytes, self.held = cache_bytes, 0

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word. ``now`` has the merge of the pair that begins at each place, or -1; the queue holds merges with their
        places, each as one number, and one that isn't its place's any more is skipped."""
        first, bits, find, n = self.first, self.bits, self.pairs.get, len(word)
        ids = [first[b] for b in word]
        now = [find(a << bits | b, -1) for a, b in zip(ids, ids[1:])]  # noqa: B905
        width, new_id = n.bit_length(), (1 << bits) - 1
        queue = [found << width | i for i, found in enumerate(now) if found >= 0]
        if not queue:
            return ids
        heapify(queue)
        now.append(-1)
        after, before, place = list(range(1, n + 2)), list(range(-1, n)), (1 << width) - 1
        while queue:
            top = heappop(queue)
            i, found = top & place, top >> width
            if now[i] != found:
                continue  # one of the two has been merged since
            j = after[i]
            ids[i] = new = found & new_id
            ids[j] = now[j] = -1
            after[i] = k = after[j]
            before[k] = i
            now[i] = found = find(new << bits | ids[k], -1) if k < n else -1
            if found >= 0:
                heappush(queue, found << width | i)
            h = before[i]
            if h >= 0:
                now[h] = found = find(ids[h] << bits | new, -1)
                if found >= 0:
                    heappush(queue, found << width | h)
        return [x for x in ids if x >= 0]

    def _keep(self, key: str, ids: bytes) -> bytes:
        """Keeps a word's ids. When the table is full it becomes the old one; what is asked for again comes over from there."""
        if len(key) <= LONGEST:
            if self.held >= self.cache_bytes // 2:
                self.old, self.kept, self.held = self.kept, {}, 0
            self.kept[key] = ids
            self.held += ENTRY + 2 * len(key) + len(ids)
        return ids

    def _word(self, word: str) -> bytes:
        return self._keep(word, self.old.get(word) or array("i", self.merge(word.encode())).tobytes())

    def _words(self, text: str) -> bytes:
        kept, make = self.kept.get, self._word
        return b"".join([kept(w) or make(w) for w in self.words(text)])

    def _after_space(self, text: str) -> bytes:
        """The ids of what stands between two spaces, with the first of them."""
        if text.isascii() and text.isalpha():
            word = " " + text
            return self.kept.get(word) or self._word(word)
        return self._words(" " + text)

    def _plain(self, text: str) -> bytes:
        first, *others = self.at_spaces(text) if self.odd(text) else text.split(" ")
        return b"".join([self._words(first), *map(self._after_space, others)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers. A special token's string in the text is that token."""
        if not any(x in text for x in self.special):
            return self._plain(text)
        return b"".join([np.array([self.special[part]], "<i4").tobytes() if k % 2 else self._plain(part) for k, part in enumerate(self.cut(text))])

    def encode_all(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text; none may be null. What stands between spaces is looked up once for all texts."""
        plain = [not (self.odd(t) or any(x in t for x in self.special)) for t in texts.to_pylist()]
        split = pc.split_pattern(pc.if_else(pa.array(plain, pa.bool_()), texts, ""), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        found = split.flatten().dictionary_encode()
        # By number: the strings after a space, then each text's beginning, or all of a text that isn't plain.
        ids = [self._after_space(x) for x in found.dictionary.to_pylist()]
        which = found.indices.to_numpy().astype(np.int64)
        begins = which[bounds[:-1]]
        which[bounds[:-1]] = len(ids) + np.arange(len(texts))
        ids += [self._words(found.dictionary[int(k)].as_py()) if ok else self.encode(t.as_py()) for k, ok, t in zip(begins, plain, texts, strict=True)]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        held, starts = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(sizes) - sizes
        many = sizes[which]
        ends = np.cumsum(many)
        values = held[np.repeat(starts[which] - ends + many, many) + np.arange(many.sum())]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends])[bounds], pa.int32()), pa.array(values))

    def decode(self, ids: list[int | None]) -> str:
        """Ids that the vocabulary hasn't are left out; bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.strings.get(k, b"") for k in ids]).decode("utf-8", "replace")

    def decode_all(self, lists: pa.ListArray) -> pa.StringArray:
        """The text of each list of ids; a null list is an empty one."""
        lists = pc.if_else(lists.is_valid(), lists, pa.scalar([], lists.type))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        ids = pc.fill_null(lists.values.cast(pa.int64()), -1).to_numpy()[bounds[0] : bounds[-1]]
        ids = np.where((ids < 0) | (ids >= len(self.lengths) - 1), len(self.lengths) - 1, ids)
        many = self.lengths[ids]
        ends = np.cumsum(many)
        text = self.letters[np.repeat(self.starts[ids] - ends + many, many) + np.arange(many.sum())].tobytes()
        cuts = np.concatenate([[0], ends])[bounds - bounds[0]].tolist()
        return pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], pa.string())  # noqa: B905


@lru_cache(maxsize=1)
def _loaded(vocabulary: str | None) -> Bpe:
    return Bpe(vocabulary)


def _per_batch(make: Callable[[Bpe, pa.Array], pa.Array], vocabulary: str | None, returns: str) -> Callable[[Column], Column]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _loaded(vocabulary)
        for batch in batches:
            yield make(bpe, batch)

    return F.arrow_udf(run, returns)


def _encode(bpe: Bpe, texts: pa.Array) -> pa.Array:
    return bpe.encode_all(pc.fill_null(texts.cast(pa.string()), ""))


def _decode(bpe: Bpe, lists: pa.Array) -> pa.Array:
    return bpe.decode_all(lists)


def encode_bpe(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """docs with the token ids of their texts (array<int>). A null or empty text has none. A column of that name is replaced, all
    others stay; rows that repeat are encoded each. ``vocabulary`` is a file in the form of the tokenizers library that
    every executor can open; null is the public one with 50,257 ids."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(ids, _per_batch(_encode, vocabulary, "array<int>")(docs[text].cast("string")))


def decode_bpe(docs: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """docs with the text that their ids (array<int>) stand for; null or no ids give an empty text. A column of that name is
    replaced."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text, _per_batch(_decode, vocabulary, "string")(docs[ids]))


def digest_bpe(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the sha256 of the ids as decimals with commas and of the decoded text."""
    both = decode_bpe(encode_bpe(docs.select("doc_id", "text"), vocabulary=vocabulary), vocabulary=vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_bpe(table(spark, sf_dir, "documents"))
