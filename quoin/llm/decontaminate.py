"""Benchmark passages in documents, by SimHash over item-sized windows.

An item's fingerprint is the SimHash of its weighted shingles, over BLOCKS blocks of WIDTH bits. A document's windows are as
long as the items are; the fingerprints of all windows of one length come from running sums over its shingles. A multi-index
over the blocks finds every item within the Hamming radius: fingerprints that differ in at most RADIUS bits differ in at
most RADIUS // BLOCKS bits of some block. The index lists items under the values near theirs, a window looks up the
values near its own, and half of the differing bits is spent on either side. Candidates are then verified by the exact
weighted similarity of their shingle sets.

A window that reaches the threshold has at least that share of its weight in shingles of items, which running sums tell
before any fingerprint is made; nothing is lost by leaving the others out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import in_batches, table
from quoin.llm.shingles import grams, mix, word_hashes

FOUND = "doc_id long, item_id long, start long, n_words long, similarity double"
SIZE = 5
#: The fingerprint, and the radius of the search. Fingerprints of sets that are 0.8 alike differ in 15.2 of 100 bits on
#: average, with a standard deviation of 3.6.
BLOCKS, WIDTH, RADIUS = 5, 20, 24
BITS = BLOCKS * WIDTH
#: Windows that are looked up at a time.
WINDOWS = 2000


@dataclass
class Index:
    """For each block, the items under every value that differs from theirs in at most half of the bits: those under value v are
    items[start[v] : start[v + 1]]."""

    starts: list[np.ndarray] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)


@dataclass
class Benchmark:
    known: np.ndarray  # all items' shingles, sorted
    common: np.ndarray  # shingles of two items or more of the whole benchmark, sorted, with their weights
    weights: np.ndarray
    unknown: float
    threshold: float
    radius: int
    ids: list[int] = field(default_factory=list)
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # each item's length
    sets: list[np.ndarray] = field(default_factory=list)
    prints: np.ndarray = field(default_factory=lambda: np.zeros((0, BLOCKS), np.int32))

    @cached_property
    def index(self) -> Index:
        """Made where it is first used, so that it isn't sent to tasks."""
        return index_of(self.prints, self.radius)

    @property
    def sizes(self) -> list[int]:
        """Shingle sizes in use: SIZE, and those of items with fewer words."""
        return sorted({min(SIZE, int(n)) for n in np.unique(self.words)})

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(shingles), self.unknown)
        at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        return np.where(self.common[at] == shingles, self.weights[at], self.unknown)

    def holds(self, shingles: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return self.known[at] == shingles


def signs(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each shingle a row of its weight (in thousandths, so that sums are exact, and a little more by its hash, so that sums
    of equal weights are seldom zero), with the sign of each bit of its mixed hashes."""
    hashes = np.stack([mix(shingles), mix(shingles ^ np.uint64(0x6A09E667F3BCC909))], axis=1)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(len(shingles), -1), axis=1)[:, :BITS]
    whole = (np.round(weights * 1000).astype(np.int64) + (hashes[:, 1] >> np.uint64(57)).astype(np.int64))[:, None]
    return np.where(bits, whole, -whole)


def prints_of(sums: np.ndarray) -> np.ndarray:
    """Rows of sums as rows of BLOCKS numbers of WIDTH bits."""
    return (sums > 0).reshape(len(sums), BLOCKS, WIDTH) @ (np.int32(1) << np.arange(WIDTH, dtype=np.int32))


@lru_cache(maxsize=8)
def near(within: int) -> np.ndarray:
    """All numbers of WIDTH bits with at most ``within`` of them set."""
    return np.array([sum(1 << b for b in bits) for k in range(within + 1) for bits in combinations(range(WIDTH), k)], np.int32)


def index_of(prints: np.ndarray, radius: int) -> Index:
    flips, out = near(-(-(radius // BLOCKS) // 2)), Index()
    for b in range(BLOCKS):
        values = (prints[:, b, None] ^ flips).ravel()
        order = np.argsort(values, kind="stable")
        out.starts.append(np.searchsorted(values[order], np.arange((1 << WIDTH) + 1)).astype(np.int32))
        out.items.append((order // len(flips)).astype(np.int32))
    return out


def probe(index: Index, prints: np.ndarray, radius: int) -> np.ndarray:
    """The pairs (position in prints, item) that some block brings together: distinct, as rows."""
    flips, found = near(radius // BLOCKS // 2), []
    for b in range(BLOCKS):
        values = prints[:, b, None] ^ flips
        first = index.starts[b][values]
        many = (index.starts[b][values + 1] - first).ravel()
        at = np.repeat(first.ravel() - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        found.append(np.repeat(np.arange(len(prints)).repeat(len(flips)), many) << 32 | index.items[b][at])
    pairs = np.unique(np.concatenate(found))
    return np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1)


def item_shingles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
    """(position, shingles, words) of each text that has words."""
    for first, words, bounds in word_hashes(texts):
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                yield first + k, grams(words[a:b], min(SIZE, b - a)), int(b - a)


def prepare(items: list[tuple[int, str | None]], threshold: float = 0.8, radius: int = RADIUS, counts: tuple[int, np.ndarray, np.ndarray] | None = None) -> Benchmark | None:
    """Fingerprints and index of items (id, text); those without words are left out. None if there are none. counts: if the
    items are a part of a benchmark, its number of items, shingles of two or more of them (sorted) and how many."""
    kept = [(items[k][0], s, n) for k, s, n in item_shingles(pa.array([t for _, t in items], pa.string()))]
    if not kept:
        return None
    known, df = np.unique(np.concatenate([np.unique(s) for _, s, _ in kept]), return_counts=True)
    total, common, df = counts or (len(kept), known[df > 1], df[df > 1])
    out = Benchmark(known, common, np.log1p(total / df), float(np.log1p(total)), threshold, radius)
    out.ids, out.words = [i for i, _, _ in kept], np.array([n for _, _, n in kept])
    out.sets = [np.unique(s) for _, s, _ in kept]
    out.prints = prints_of(np.stack([signs(s, out.weigh(s)).sum(0) for _, s, _ in kept]))
    return out


def candidates(benchmark: Benchmark, prints: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """(position in prints, item) of all items within the radius that have as many words as the window was made for."""
    pairs = probe(benchmark.index, prints, benchmark.radius)
    pairs = pairs[benchmark.words[pairs[:, 1]] == words[pairs[:, 0]]]
    close = distances(prints[pairs[:, 0]], benchmark.prints[pairs[:, 1]]) <= benchmark.radius
    return list(map(tuple, pairs[close].tolist()))


def similarity(a: np.ndarray, b: np.ndarray, benchmark: Benchmark) -> float:
    """Weight of the shared shingles over the weight of all; a and b are sorted and distinct."""
    both = benchmark.weigh(np.intersect1d(a, b, assume_unique=True)).sum()
    every = benchmark.weigh(a).sum() + benchmark.weigh(b).sum() - both
    return float(both / every) if every else 0.0


def regions(hits: np.ndarray, reach: int, end: int, most: int = 20_000) -> list[tuple[int, int]]:
    """Bounds of the stretches of shingles that windows around hits can cover. Stretches longer than ``most`` are cut into
    overlapping ones, so that a very long document's sums are held in parts."""
    out: list[list[int]] = []
    for low, high in zip(np.maximum(0, hits - reach).tolist(), np.minimum(end, hits + reach).tolist(), strict=True):
        if out and low <= out[-1][1] and high - out[-1][0] <= most:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def search(words: np.ndarray, hits: dict[int, np.ndarray], shingles: dict[int, np.ndarray], benchmark: Benchmark) -> list[tuple[int, int, int, float]]:
    """(item_id, start, words, similarity) of the best window for each item found in a document's word hashes. hits: by shingle
    size, positions of shingles that some item has. Of equal windows the first counts."""
    best: dict[int, tuple[float, int, int]] = {}
    n, lengths = len(words), np.unique(benchmark.words).tolist()
    for size, at in hits.items():
        for low, high in regions(at, lengths[-1], n - size + 1):
            run = shingles[size][low:high]
            weights = benchmark.weigh(run)
            total = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(signs(run, weights), axis=0)])
            held = np.zeros(high - low)
            mine = at[(at >= low) & (at < high)] - low
            held[mine] = weights[mine]
            mass, cover = (np.concatenate([[0.0], np.cumsum(w)]) for w in (np.where(repeats(run), 0.0, weights), held))
            asked: list[tuple[np.ndarray, int, int]] = []
            for length in lengths:
                span = min(length, n) - size + 1
                if min(SIZE, length) != size or not 1 <= span <= high - low:
                    continue
                starts = np.flatnonzero(cover[span:] - cover[:-span] >= benchmark.threshold * (mass[span:] - mass[:-span]) - 1e-9)
                starts = starts[cover[starts + span] > cover[starts]]
                asked += [(starts[k : k + WINDOWS], span, length) for k in range(0, len(starts), WINDOWS)]
            for some in groups(asked):
                first = np.concatenate([x[0] for x in some])
                spans, words_of = (np.repeat([x[k] for x in some], [len(x[0]) for x in some]) for k in (1, 2))
                for at_window, item in candidates(benchmark, prints_of(total[first + spans] - total[first]), words_of):
                    start, span = low + int(first[at_window]), int(spans[at_window])
                    likeness = similarity(np.unique(shingles[size][start : start + span]), benchmark.sets[item], benchmark)
                    if likeness >= benchmark.threshold - 1e-12 and (likeness, -start) > best.get(benchmark.ids[item], (0.0, 1, 0))[:2]:
                        best[benchmark.ids[item]] = (likeness, -start, span + size - 1)
    return [(i, -s, w, p) for i, (p, s, w) in sorted(best.items())]


def groups(asked: list[tuple[np.ndarray, int, int]]) -> Iterator[list[tuple[np.ndarray, int, int]]]:
    """Together WINDOWS windows in a group, or less than twice as many."""
    group: list[tuple[np.ndarray, int, int]] = []
    for x in asked:
        group.append(x)
        if sum(len(y[0]) for y in group) >= WINDOWS:
            yield group
            group = []
    if group and any(len(x[0]) for x in group):
        yield group


def repeats(run: np.ndarray) -> np.ndarray:
    """Whether a shingle stands earlier in the run too."""
    out = np.ones(len(run), bool)
    out[np.unique(run, return_index=True)[1]] = False
    return out


def shingle_counts(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of items (item_id, t) with words, shingles of two or more of them (sorted) and how many."""

    def make(batches):
        for batch in batches:
            for _, s, _ in item_shingles(batch.column(0)):
                own = np.append(np.unique(s).view(np.int64), 0)  # the last one counts the items
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.arange(len(own)) == len(own) - 1)], names=["shingle", "whole"])

    found = in_batches(items.select("t"), make, "shingle long, whole boolean").groupBy("shingle", "whole").count().filter("whole or count > 1").collect()
    shared = sorted((r.shingle % 2**64, r["count"]) for r in found if not r.whole)
    return sum(r["count"] for r in found if r.whole), np.array([s for s, _ in shared], np.uint64), np.array([n for _, n in shared], np.int64)


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", radius: int = RADIUS, threshold: float = 0.8, max_broadcast_items: int = 10_000) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): for each row of docs and each item in it, the most similar window of the
    item's length in words, if it reaches ``threshold``.

    Weights are ln(1 + items / items with the shingle), over the whole benchmark. An item with fewer than five words is one
    shingle. Null, empty and blank texts hold nothing and no item is found in them; equal rows of docs give equal rows, and items
    with equal ids and texts count once. Items are taken in blocks of max_broadcast_items (more only if one id has more texts), each of
    which meets all documents; blocks of any size give the same rows. A task holds one block with its index (5 * 211
    places of four bytes for each item) and the index's 5 * 2 ** 20 starts, and looks up WINDOWS windows at a time.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(item_text).cast("string").alias("t")).dropna().distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    counts, found, more = shingle_counts(items), None, True
    while more:
        block = items.orderBy("item_id", "t").limit(max_broadcast_items + 1).collect()
        more = len(block) > max_broadcast_items
        if more:
            first, last = block[0].item_id, block[-1].item_id
            block = [r for r in block if r.item_id < last] if first < last else items.filter(F.col("item_id") == first).collect()
            items = items.filter(F.col("item_id") > block[-1].item_id)
        part = _search_block(rows, prepare([(r.item_id, r.t) for r in block], threshold, radius, counts))
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(rows: DataFrame, prepared: Benchmark | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(prepared)

    def look(batches):
        benchmark = shared.value
        if benchmark is None:
            return
        seen = np.zeros(1 << 20, bool)
        seen[(benchmark.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for first, words, bounds in word_hashes(batch.column(1)):
                hits: dict[int, np.ndarray] = {}
                for size in benchmark.sizes:
                    every = grams(words, size)
                    at = np.flatnonzero(seen[(every & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    at = at[benchmark.holds(every[at])] if len(at) else at
                    hits[size] = at
                touched = sorted({int(i) for at in hits.values() for i in np.unique(np.searchsorted(bounds, at, side="right") - 1)})
                for i in touched:
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    own = words[a:b]
                    inside = {s: at[(at >= a) & (at <= b - s)] - a for s, at in hits.items()}
                    for item, start, w, p in search(own, inside, {s: grams(own, s) for s in benchmark.sizes}, benchmark):
                        out.append((ids[first + i], item, start, w, p))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    return in_batches(rows, look, FOUND)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
