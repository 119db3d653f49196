"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes a sparse vector of hashed terms (its words), of pairs and hashed triples of character classes, and of levels of
repetition and shape, weighted by how few of the sample have each. A truncated singular value decomposition of a bounded
labelled sample gives the latent space; its vectors and labels are broadcast (their number is a parameter). For every
document the exact cosines with all of them are computed in blocks, and the nearest vote with their labels, weighted
by similarity.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import held_out, in_batches, table

#: Character classes: lower, upper, digit, blank, newline, other white space, each ASCII sign, and what is left.
CLASSES = np.full(256, 6, np.int64)
CLASSES[ord("a") : ord("z") + 1], CLASSES[ord("A") : ord("Z") + 1], CLASSES[ord("0") : ord("9") + 1] = 0, 1, 2
CLASSES[128:] = 0  # parts of letters outside ASCII
for _k, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    CLASSES[ord(_c)] = 7 + _k
CLASSES[32], CLASSES[10], CLASSES[[9, 11, 12, 13]] = 3, 4, 5
N_CLASSES = 39
TRIPLES = 1024
LEVELS = 16
SHAPES = ("distinct_words", "distinct_lines", "repeats", "upper", "signs", "digits", "word_length", "line_length", "length", "title")
TERMS, TERM_SHARE = 2048, 0.5
WIDTH = N_CLASSES**2 + TRIPLES + LEVELS * len(SHAPES) + TERMS


def _level(value: float) -> int:
    return int(min(LEVELS - 1, max(0.0, value * LEVELS)))


def text_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of a text's vector of unit length per group of features."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    codes = CLASSES[raw]
    at, values = [], []
    if len(codes) > 1:
        pairs = codes[:-1] * N_CLASSES + codes[1:]
        found = np.bincount(pairs, minlength=N_CLASSES**2)
        where = np.flatnonzero(found)
        v = np.sqrt(found[where])
        at.append(where)
        values.append(v / np.linalg.norm(v))
        if len(codes) > 2:
            mixed = (pairs[:-1] * N_CLASSES + codes[2:]) * 40503 % 65521 % TRIPLES
            found = np.bincount(mixed, minlength=TRIPLES)
            where = np.flatnonzero(found)
            v = np.sqrt(found[where])
            at.append(where + N_CLASSES**2)
            values.append(v / np.linalg.norm(v))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(raw))
    by_class = np.bincount(codes, minlength=N_CLASSES) / n
    runs = [" ".join(words[i : i + 3]) for i in range(0, len(words) - 2)] if len(words) < 400 else list(zip(words, words[1:], words[2:]))
    shapes = (
        len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), len(set(runs)) / max(1, len(runs)), by_class[1], float(by_class[6:].sum()) * 2, by_class[2] * 4,
        len(text) / max(1, len(words)) / 16, np.log1p(len(text) / max(1, len(lines))) / 10, np.log1p(len(words)) / 10, sum(w[0].isupper() for w in words) / max(1, len(words)),
    )
    first = N_CLASSES**2 + TRIPLES
    at.append(np.array([first + LEVELS * k + _level(float(s)) for k, s in enumerate(shapes)]))
    values.append(np.full(len(shapes), 1 / np.sqrt(len(shapes))))
    terms = Counter(text.lower().split())
    if terms:
        found = np.bincount([crc32(w.encode("utf-8", "surrogatepass")) % TERMS for w in terms], np.sqrt(list(terms.values())), TERMS)
        where = np.flatnonzero(found)
        at.append(where + WIDTH - TERMS)
        values.append(TERM_SHARE * found[where] / np.linalg.norm(found))
    return np.concatenate(at), np.concatenate(values)


@dataclass
class Voters:
    """Labelled unit vectors in the latent space."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = 15
    power: float = 12.0

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.basis.shape[1]), np.float32)
        for i, (at, values) in enumerate(rows):
            out[i] = (values * self.weights[at]).astype(np.float32) @ self.basis[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, weighted by a power of the cosine; ties go by the order of the sample."""
        if not len(self.labels):
            return np.full(len(vectors), 0.5)
        cosines = vectors @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
        tied = cosines == least
        tied &= np.cumsum(tied, axis=1) <= k - (cosines > least).sum(1, keepdims=True)
        near = np.nonzero((cosines > least) | tied)[1].reshape(-1, k)
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-3).astype(float) ** self.power
        return np.clip((weight * self.labels[near]).sum(1) / weight.sum(1), 0, 1)


def fit_voters(docs: DataFrame, labels: DataFrame, train_rows: int = 4000, dimensions: int = 48) -> Voters:
    """Voters from at most train_rows labelled documents outside the held-out fold, in the order of their ids' hashes. The
    driver holds their sparse vectors, not their texts. Without labels every score is 0.5."""
    few = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna().filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    few = few.groupBy("doc_id").agg(F.min("y").alias("y"))

    def vectors(batches):
        for batch in batches:
            rows = [text_vector(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["doc_id", "y", "at", "v"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    found = in_batches(texts, vectors, "doc_id long, y int, at array<long>, v array<double>")
    # Repeated rows of a document count once, so that no more than train_rows reach the driver.
    rows = found.groupBy("doc_id").agg(F.min_by(F.struct("y", "at", "v"), F.struct(F.size("at"), "at", "v")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    n = rows.num_rows
    if not n:
        return Voters(np.ones(WIDTH), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    matrix = np.zeros((n, WIDTH), np.float32)
    for i, (at, v) in enumerate(zip(rows["at"].to_pylist(), rows["v"].to_pylist(), strict=True)):
        matrix[i, at] = v
    weights = np.log((1 + n) / (1 + (matrix > 0).sum(0))) + 0.3
    matrix *= weights.astype(np.float32)
    basis = leading(matrix, min(dimensions, n))
    latent = matrix @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Voters(weights, basis, latent, np.array(rows["y"].to_pylist(), float))


def leading(matrix: np.ndarray, dimensions: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """The right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    start = np.random.default_rng(seed).standard_normal((matrix.shape[1], min(dimensions + 16, *matrix.shape)))
    q = np.linalg.qr(start)[0].astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(matrix.T @ (matrix @ q))[0]
    return (q @ np.linalg.svd(matrix @ q, full_matrices=False)[2].T)[:, :dimensions].astype(np.float32)


def score_quality(docs: DataFrame, voters: Voters, text: str = "text", block: int = 512) -> DataFrame:
    """Adds quality (0 to 1, higher is better), replacing a column so named. A null text counts as empty and is scored like
    any other; equal rows stay separate rows."""
    kept = [c for c in docs.columns if c.lower() != "quality"]
    rows, at = docs.select(*kept), kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def score(batches):
        model = shared.value
        for batch in batches:
            texts, found = batch.column(at), [np.zeros(0)]
            for i in range(0, len(texts), block):
                found.append(model.vote(model.project([text_vector(t or "") for t in texts.slice(i, block).to_pylist()])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found), pa.float64())], names=[*kept, "quality"])

    return in_batches(rows, score, T.StructType([*rows.schema.fields, T.StructField("quality", T.DoubleType())]))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_voters(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))
