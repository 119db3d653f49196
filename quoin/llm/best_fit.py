"""Best-fit packing by large-item matching, planned on the histogram of lengths.

How many pieces there are of each length is all that a packing depends on, and there are no more lengths than the capacity. So
Spark counts the lengths, the plan is made on these counts, and each piece finds its place from its rank among the pieces
of its length. The plan: pieces above a third of the capacity share a sequence with at most one other such piece, and
the largest is matched with the largest that fits beside it; smaller pieces, in decreasing size, go where the least room
is left that holds them; then new sequences are opened. Nothing that grows with the corpus passes the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import in_batches, store, table
from quoin.llm.tokens import crc, encoder, pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
#: length; the first rank and how many ranks; the first sequence, pieces of this length in each, and where they begin.
Run = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs by which the pieces of each length, by rank, go to sequences. All the work is by length, not by piece."""
    left = {n: c for n, c in counts.items() if c}
    taken: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)
    rooms: list[int] = []
    sequences = 0

    def put(length: int, first: int, many: int, each: int, offset: int, items: int) -> None:
        runs.append((length, taken[length], items, first, each, offset))
        taken[length] += items
        left[length] -= items

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            if not gaps[room]:
                insort(rooms, room)
            gaps[room].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        many = left[n]
        at = bisect_left(large, capacity - n + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        mate = large[at] if at >= 0 else None
        if mate == n:
            pairs = many // 2
            if pairs:
                put(n, sequences, pairs, 2, 0, 2 * pairs)
                leave(capacity - 2 * n, sequences, pairs)
                sequences += pairs
            if left[n]:
                if at > 0:
                    mate = large[at - 1]
                else:
                    put(n, sequences, 1, 1, 0, 1)
                    leave(capacity - n, sequences, 1)
                    sequences += 1
                    mate = None
            else:
                mate = None
        elif mate is None:
            put(n, sequences, many, 1, 0, many)
            leave(capacity - n, sequences, many)
            sequences += many
        if mate is not None and left[n]:
            pairs = min(left[n], left[mate])
            put(n, sequences, pairs, 1, 0, pairs)
            put(mate, sequences, pairs, 1, n, pairs)
            leave(capacity - n - mate, sequences, pairs)
            sequences += pairs
        large = [x for x in large if left[x]]
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        while left[n]:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                room, first, many = capacity, sequences, -(-left[n] // (capacity // n))
                sequences += many
            else:
                room = rooms[at]
                first, many = gaps[room].pop()
                if not gaps[room]:
                    rooms.pop(at)
            each = room // n
            full = min(many, left[n] // each)
            offset = capacity - room
            if full:
                put(n, first, full, each, offset, full * each)
                leave(room - each * n, first, full)
            rest = left[n] if full < many else 0
            if rest:
                put(n, first + full, 1, rest, offset, rest)
                leave(room - rest * n, first + full, 1)
                full += 1
            leave(room, first + full, many - full)
    return runs


def cut_documents(docs: DataFrame, capacity: int = 2048, last_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text); nulls are empty texts. ``task`` and ``nth`` number the pieces
    of one length within one task."""

    def cut(batches):
        seen, task = defaultdict(int), TaskContext.get().partitionId()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        with encoder(vocabulary) as words:
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, start, ids in pieces(words.encode(text or ""), capacity, last_id):
                        n = len(ids) // 4
                        rows.append((doc, k, start, n, crc(ids), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES)


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a stored result of cut_documents. Equal rows keep places of their own; an empty table
    stays empty."""
    each = cut.groupBy("task", "length").count()
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = each.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))  # a length has a row for each task
    ranked = cut.join(first, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    grouped = defaultdict(list)
    for n, *run in plan(counts, capacity):
        grouped[n].append(run)
    by_length = {n: np.array(sorted(runs), np.int64) for n, runs in grouped.items()}
    shared = cut.sparkSession.sparkContext.broadcast(by_length)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def look_up(batches):
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                held = shared.value[int(n)]
                run = held[np.searchsorted(held[:, 0], ranks[rows], side="right") - 1]
                within = ranks[rows] - run[:, 0]
                sequence[rows] = run[:, 2] + within // run[:, 3]
                offset[rows] = run[:, 4] + within % run[:, 3] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return in_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), look_up, out)


def pack_best_fit(docs: DataFrame, capacity: int = 2048, last_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Packs every row's ids into sequences of at most ``capacity`` ids: a row for each piece with its sequence and offset."""
    return place(store(cut_documents(docs, capacity, last_id, vocabulary), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))
