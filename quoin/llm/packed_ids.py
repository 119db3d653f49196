"""Token-id matrices: best-fit-decreasing packing inside each task, with a segment tree over the rooms left.

A task encodes its own documents and packs them group by group (``group_tokens`` ids at most are held), so nothing is
shuffled and a lost task repeats only its own share. Overlong documents are cut into sequences without loss.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import in_batches, store, table
from quoin.llm.tokens import encoder, pieces

SEQUENCES = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, id_bytes int, ids binary"


class Rooms:
    """Open sequences by the room that they have left; the tree finds the least room that holds a piece."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += by
            at >>= 1

    def add(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the least room of at least ``need``, no longer open; None if there is none."""
        at = need + self.size
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        room = at - self.size
        self._count(room, -1)
        return room, self.held[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions in ``lengths`` by sequence."""
    rooms, out = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found:
            room, at = found
            out[at].append(i)
        else:
            room, at = capacity, len(out)
            out.append([i])
        if room - lengths[i]:
            rooms.add(room - lengths[i], at)
    return out


def pack_ids(docs: DataFrame, capacity: int = 2048, last_id: int = 0, group_tokens: int = 4_000_000, vocabulary: str | None = None) -> DataFrame:
    """A row for each sequence: the ids (little-endian unsigned, id_bytes each: two, or four where the vocabulary has larger ids;
    padded with ``last_id`` to capacity), cumulative segment lengths from 0, where positions begin anew, and each segment's document and piece. Null texts are empty and hold
    the closing id alone; equal rows are packed each."""

    def pack(batches):
        base, made = TaskContext.get().partitionId() << 36, 0
        held: list[tuple[int, int, bytes]] = []
        tokens = 0

        def rows(width: int):
            nonlocal made
            out = []
            for members in best_fit_decreasing([len(x[2]) // 4 for x in held], capacity):
                ids = np.full(capacity, last_id, f"<u{width}")
                ends = np.cumsum([0] + [len(held[i][2]) // 4 for i in members])
                ids[: ends[-1]] = np.frombuffer(b"".join(held[i][2] for i in members), "<u4")
                out.append((base + made, int(ends[-1]), [held[i][0] for i in members], [held[i][1] for i in members], ends.tolist(), ends[:-1].tolist(), width, ids.tobytes()))
                made += 1
                if len(out) == 1000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        with encoder(vocabulary) as words:
            width = 2 if max(words.largest, last_id) < 1 << 16 else 4
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, _, ids in pieces(words.encode(text or ""), capacity, last_id):
                        held.append((doc, k, ids))
                        tokens += len(ids) // 4
                    if tokens >= group_tokens:
                        yield from rows(width)
                        held, tokens = [], 0
            yield from rows(width)

    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary())
    names = [c.split()[0] for c in SEQUENCES.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), pack, SEQUENCES)


def digest(sequences: DataFrame) -> DataFrame:
    """A sequence's arrays, and check sums of the ids as they are stored and of the positions that they stand for."""
    out = "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids_crc32 long, positions_crc32 long"

    def sums(batches):
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            ends = columns["cu_seqlens"].to_pylist()
            ids, resets = columns["ids"].to_pylist(), columns["position_resets"].to_pylist()
            positions = [zlib.crc32(np.concatenate([np.arange(b - a) for a, b in zip(r, e[1:], strict=True)]).astype("<u4").tobytes()) for r, e in zip(resets, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [columns["sequence_id"], columns["n_tokens"], pa.array([len(e) - 1 for e in ends], pa.int32()), columns["doc_ids"], columns["pieces"], columns["cu_seqlens"], pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(positions, pa.int64())],
                names=[c.split()[0] for c in out.split(", ")],
            )

    return in_batches(sequences, sums, out)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(pack_ids(table(spark, sf_dir, "documents")), "packed_ids"))
