"""Hard negatives by distributed radix selection over integer scores.

Anchors are a stated query set: they are taken in blocks of at most ``block`` and each block is broadcast to all rows, which stay
where they are. A search is a window of scores for an anchor: one for its positives, then one for each of its positives.
For each window the tasks count scores by their leading digit, and Spark sums these histograms and finds the bucket with
the k-th score; the next pass counts only that bucket by the next digit, until the k-th score is known. Then
only rows from that score up are gathered. Of rows that tie there a task sends no more than the k with the smallest ids, so
a group of copies of any size stays where it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import shared_dir, store, table

#: Rows that meet a block at once, histogram cells of one task, and scores held before they are counted.
ROWS, CELLS, HELD = 512, 1 << 22, 1 << 20
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Block:
    """Anchors by number: ids, labels, and for each length of vectors the numbers and the matrix; ``norm`` is that of the longest row."""

    ids: np.ndarray
    labels: np.ndarray
    matrices: dict[int, tuple[np.ndarray, np.ndarray]]
    norm: float

    def norms(self) -> np.ndarray:
        out = np.zeros(len(self.ids))
        for numbers, matrix in self.matrices.values():
            out[numbers] = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
        return out

    def exact(self) -> type:
        """The cheapest type in which inner products with rows are exact: no partial sum is larger than the product of the norms."""
        most = 1.001 * self.norm * max(self.norms(), default=0.0)
        for kind, bits in ((np.float32, 24), (np.float64, 53), (np.int64, 62)):
            if most < 2**bits:
                return kind
        raise ValueError("inner products of these vectors don't fit in 62 bits")


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and v: each component x as floor(256 * x). Rows with a null label, a null vector or any null or non-finite
    component take no part, nor rows without an id, as there is nothing to return for them."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))


def _scored(block: Block, same: bool, least: np.ndarray, most: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor numbers, vec_ids, scores) of rows with the anchor's label (the anchor's own id left out) or with another one, whose
    score lies between least and most of the anchor."""
    kind = block.exact()
    ready = {n: (numbers, matrix.astype(kind), block.labels[numbers]) for n, (numbers, matrix) in block.matrices.items()}
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
        lists = batch.column("v")
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sizes = np.diff(bounds)
        for n in np.unique(sizes):
            if int(n) not in ready:
                continue
            numbers, matrix, own = ready[int(n)]
            rows = np.flatnonzero(sizes == n)
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                held = values[(bounds[some][:, None] + np.arange(n)[None, :])].astype(kind) if n else np.zeros((len(some), 0), kind)
                if same:
                    pairs = [(np.flatnonzero(own == x), np.flatnonzero(labels[some] == x)) for x in np.intersect1d(own, labels[some])]
                else:
                    pairs = [(np.arange(len(numbers)), np.arange(len(some)))]
                for a, r in pairs:
                    score = matrix[a] @ held[r].T
                    k = numbers[a]
                    fits = (score >= least[k][:, None]) & (score <= most[k][:, None])
                    fits &= (block.ids[k][:, None] != ids[some][r][None, :]) if same else (own[a][:, None] != labels[some][r][None, :])
                    i, j = np.nonzero(fits)
                    if len(i):
                        yield k[i], ids[some][r][j], score[i, j].astype(np.int64)


def _windows(low: np.ndarray, high: np.ndarray, hits: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hits of anchors as hits of each of their windows: (window, vec_id, score)."""
    many = low.shape[1]
    for k, ids, score in hits:
        for j in range(many):
            ok = (score >= low[k, j]) & (score <= high[k, j])
            if ok.any():
                yield k[ok] * many + j, ids[ok], score[ok]


def _bounds(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that any open window of an anchor takes; none is open: nothing fits."""
    open_ = low <= high
    return np.where(open_, low, np.iinfo(np.int64).max).min(axis=1), np.where(open_, high, np.iinfo(np.int64).min).max(axis=1)


def count_digits(rows: DataFrame, shared, low: np.ndarray, high: np.ndarray, need: np.ndarray, same: bool, shift: int, digits: int) -> DataFrame:
    """For each window the bucket with its need-th score from the top, and the rows before that bucket: window, bucket, before.
    Windows with fewer rows are left out."""
    state = rows.sparkSession.sparkContext.broadcast((low, high, need))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, need = state.value
        tops, cells, keys, held = high.ravel(), np.zeros(low.size * digits, np.int64), [], 0

        def flush() -> None:
            if keys:
                cells[:] += np.bincount(np.concatenate(keys), minlength=len(cells))
                keys.clear()

        for window, _, score in _windows(low, high, _scored(shared.value, same, *_bounds(low, high), batches)):
            keys.append(window * digits + ((tops[window] - score) >> shift))
            held += len(window)
            if held >= HELD:
                flush()
                held = 0
        flush()
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full // digits), pa.array(full % digits), pa.array(need.ravel()[full // digits]), pa.array(cells[full])], names=["window", "bucket", "need", "n"])

    sums = rows.mapInArrow(count, "window long, bucket long, need long, n long").groupBy("window", "need", "bucket").agg(F.sum("n").alias("n"))
    until = F.sum("n").over(Window.partitionBy("window").orderBy("bucket"))  # a window has at most ``digits`` rows
    return sums.withColumn("until", until).filter("until >= need and until - n < need").select("window", "bucket", (F.col("until") - F.col("n")).alias("before"))


def kth_scores(rows: DataFrame, shared, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> np.ndarray:
    """The k-th score from the top of each window (anchors x windows, from low to high), or low where there are fewer rows."""
    threshold, low, high, need = low.copy(), low.copy(), high.copy(), np.full(low.shape, k, np.int64)
    bits = max(1, (CELLS // max(1, low.size)).bit_length() - 1)
    shift = max(0, int((high - low).max(initial=0)).bit_length() - bits)
    while (low <= high).any():
        found = count_digits(rows, shared, low, high, need, same, shift, 1 << bits).toArrow()  # a row for each window of the block at most
        window, bucket, before = (found.column(c).to_numpy() for c in ("window", "bucket", "before"))
        at = np.unravel_index(window, low.shape)
        top = high[at] - (bucket << shift)
        bottom = np.maximum(low[at], top - (1 << shift) + 1)
        low[:], high[:] = 1, 0
        low[at], high[at] = bottom, top
        need[at] -= before
        if not shift:
            threshold[at] = top
            break
        shift = max(0, shift - bits)
    return threshold


def gather(rows: DataFrame, shared, threshold: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """The first k rows of each window from its threshold to high: window, rank, vec_id, score."""
    state = rows.sparkSession.sparkContext.broadcast((threshold, high))

    def best(window: np.ndarray, ids: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((ids, -score, window))
        window = window[order]
        place = np.arange(len(window)) - np.searchsorted(window, window, side="left")
        return [x[order][place < k] for x in (ids, score)] + [window[place < k]]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = state.value
        held: list[tuple[np.ndarray, ...]] = []
        n, limit = 0, HELD
        for hit in _windows(low, high, _scored(shared.value, same, *_bounds(low, high), batches)):
            held.append(hit)
            n += len(hit[0])
            if n >= limit:
                ids, score, window = best(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n = [(window, ids, score)], len(window)
                limit = max(HELD, 2 * n)  # n is at most k for each window now
        if held:
            ids, score, window = best(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(ids), pa.array(score)], names=["window", "vec_id", "score"])

    first = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")  # at most k rows of each task
    return rows.mapInArrow(take, "window long, vec_id long, score long").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, block: int = 1024) -> DataFrame:
    """For each anchor (vec_id, label, v) its first ``positives`` other rows of the same label in vectors (all, if fewer), and for
    each of these the first ``negatives`` rows of other labels whose score lies between low_percent and high_percent of the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its inner product with the anchor; higher ones come first, ties by smaller vec_id. Vectors hold integers
    (integer_vectors); a row of another length than its anchor is no candidate. Anchors equal in id, label and vector are
    one; other rows that repeat an id are each a row of their own, but not another row of their own anchor. Windows of negative
    positives are empty where the upper bound is below the lower one. No anchors give no rows. Inner products must fit in 62 bits,
    else ValueError. A block of anchors, its windows and one row for each of them are all that passes through the driver.
    """
    spark = vectors.sparkSession
    rows = store(vectors.select("vec_id", "label", "v").repartition(4 * spark.sparkContext.defaultParallelism), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    norm = rows.agg(F.sqrt(F.max(square))).first()[0] or 0.0
    asked = store(anchors.select("vec_id", "label", "v").distinct(), "anchors")
    blocks = -(-asked.count() // block)
    path = f"{shared_dir(spark).rstrip('/')}/quoin/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], OUT).write.parquet(path)
    for part in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == part).toArrow()
        ids, labels, lists = own.column("vec_id").to_numpy(), own.column("label").to_numpy(), own.column("v").to_pylist()
        by_length = {n: np.array([i for i, v in enumerate(lists) if len(v) == n], np.int64) for n in {len(v) for v in lists}}
        here = Block(ids, labels, {n: (numbers, np.array([lists[i] for i in numbers], np.int64).reshape(len(numbers), n)) for n, numbers in by_length.items()}, norm)
        if not len(ids):
            continue
        here.exact()
        shared = spark.sparkContext.broadcast(here)
        most = (np.ceil(1.001 * here.norms() * norm) + 1).astype(np.int64)[:, None]
        found = gather(rows, shared, kth_scores(rows, shared, -most, most, positives, True), most, positives, True).toArrow()  # ``positives`` rows for each anchor
        low, high, names = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64), []
        for anchor, rank, vec_id, score in zip(*(found.column(c).to_pylist() for c in ("window", "rank", "vec_id", "score")), strict=True):
            low[anchor, rank - 1], high[anchor, rank - 1] = -(-low_percent * score // 100), high_percent * score // 100
            names.append((anchor * positives + rank - 1, int(ids[anchor]), vec_id, score))
        threshold = kth_scores(rows, shared, low, high, negatives, False)
        mined = gather(rows, shared, threshold, high, negatives, False).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        sought = spark.createDataFrame(names, "window long, anchor_id long, positive_id long, positive_score long")
        mined.join(F.broadcast(sought), "window").select(*(c.split()[0] for c in OUT.split(", "))).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(OUT).parquet(path)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vectors = integer_vectors(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return mine_hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"))


#: The same rows by scoring every row for every anchor.
ORACLE_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM (SELECT * FROM vectors WHERE vec_id % 100 = 0) a JOIN vectors r ON a.vec_id <> r.vec_id OR a.label <> r.label
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER best <= 10
"""
