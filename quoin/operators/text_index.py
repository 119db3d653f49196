"""Substring search by an inverted index of trigrams.

A posting list of a trigram is kept in blocks of ids, so that a trigram of many texts is many rows of bounded size. The files are
partitioned by a hash of the trigram and sorted by it: a search reads only the folders of its trigrams, and there the row
groups that may hold them. The lists of all trigrams of the words are intersected block by block; texts that hold all
trigrams are candidates, and an exact check of those decides. New and changed texts are added; lists of texts that have
changed or gone since only make candidates that the check drops.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators.catalog import listed, sold_counts
from quoin.sources.market import Market
from quoin.sources.stored import shared_dir

#: Ids of one block have all but their last 16 bits in common.
BLOCK_BITS = 16
#: So many ids are held in lists before they are handed on.
HELD_IDS = 2_000_000


def trigrams(text: Column) -> Column:
    """The distinct runs of three code points of a text, as a column (the index takes the same in batches); none of a null or shorter one. Long texts are cut into overlapping parts
    first, as taking the k-th sign of a text is linear in k."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)(?=(.{1,66})).{1,64}"), F.lit(1))
    starts = lambda part: F.when(F.length(part) >= 3, F.sequence(F.lit(1), F.length(part) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(parts, lambda part: F.transform(starts(part), lambda k: F.substr(part, k, F.lit(3))))))


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, ids) of rows (id, text): the lists of many texts at once, so that lists are shuffled and not single ids."""

    def batch_of(lists: dict[int, dict[str, list[int]]]) -> pa.RecordBatch:
        rows = [(gram, block, ids) for block, grams in lists.items() for gram, ids in grams.items()]
        grams, blocks, ids = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(blocks, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["gram", "block", "ids"])

    for batch in batches:
        lists: dict[int, dict[str, list[int]]] = {}
        held = 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            of = lists.setdefault(key >> BLOCK_BITS, defaultdict(list))
            grams = {text[k : k + 3] for k in range(len(text) - 2)}
            for gram in grams:
                of[gram].append(key)
            held += len(grams)
            if held >= HELD_IDS:
                yield batch_of(lists)
                lists, held = {}, 0
        yield batch_of(lists)


@dataclass
class TrigramIndex:
    """An index in a folder that all executors reach."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def add(self, rows: DataFrame, id_column: str, text: str) -> TrigramIndex:
        """Adds rows' texts; ids are whole numbers. Rows that repeat do no harm, rows with null ids aren't found."""
        texts = rows.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
        parts = texts.mapInArrow(posting_lists, "gram string, block long, ids array<long>")
        lists = parts.groupBy("gram", "block").agg(F.collect_list("ids").alias("ids"))
        out = lists.withColumn("bucket", self.bucket(F.col("gram"))).repartitionByRange("bucket", "gram", "block").sortWithinPartitions("bucket", "gram", "block").withColumn("ids", F.flatten("ids"))
        out.write.mode("append").partitionBy("bucket").parquet(self.path)
        return self

    def postings(self, grams: list[str]) -> DataFrame:
        """The blocks of the posting lists of the trigrams; other folders aren't read."""
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self.bucket(F.col("gram"))).distinct().collect()  # a row for each trigram of the words
        lists = self.spark.read.schema("gram string, block long, ids array<long>, bucket int").parquet(self.path)
        return lists.filter(F.col("bucket").isin([r[0] for r in asked]) & F.col("gram").isin(grams)).select("gram", "block", "ids")

    def candidates(self, words: list[str]) -> DataFrame | None:
        """(id) of texts that hold every trigram of the words; None if no word has three signs, so that the index can't help."""
        grams = sorted({w[k : k + 3] for w in words for k in range(len(w) - 2)})
        if not grams:
            return None
        lists = self.postings(grams).groupBy("block", "gram").agg(F.flatten(F.collect_list("ids")).alias("ids")).groupBy("block").agg(F.collect_list("ids").alias("lists"))
        full = lists.filter(F.size("lists") == len(grams))  # at most one list of 65,536 ids for each trigram
        shared = F.aggregate(F.slice("lists", 2, len(grams)), F.array_distinct(F.col("lists")[0]), F.array_intersect)
        return full.select(F.explode(shared).alias("id"))


def build_index(rows: DataFrame, id_column: str, text: str, buckets: int = 64) -> TrigramIndex:
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/quoin/trigrams-{uuid.uuid4().hex}"
    return TrigramIndex(rows.sparkSession, path, buckets).add(rows, id_column, text)


def containing(rows: DataFrame, words: list[str], index: TrigramIndex, id_column: str = "id", text: str = "title_norm") -> DataFrame:
    """The rows whose text holds every word, as they are; the index must hold their texts. Null texts hold none; no words hold all."""
    found = index.candidates(words)
    if found is not None:
        rows = rows.join(found.withColumnRenamed("id", "candidate"), F.col(id_column) == F.col("candidate"), "left_semi")
    for word in words:
        rows = rows.filter(F.col(text).contains(word))
    return rows


def search_indexed(m: Market, words: list[str]) -> DataFrame:
    index = build_index(m.product, "id", "title_norm")
    return containing(listed(m), words, index).select("id", "title", "vendor_id", "store_name", "category_id", F.col("base_price").cast("double").alias("base_price"))


def suggest_indexed(m: Market, phrase: str = "ring", limit: int = 6) -> DataFrame:
    """The best sold listed products whose normalised title holds the phrase, found by the index."""
    index = build_index(m.product, "id", "title_norm")
    sold = F.coalesce("sold_count", F.lit(0)).alias("sold_count")
    rows = containing(listed(m), [phrase], index).select("id", "title").join(sold_counts(m).withColumnRenamed("product_id", "id"), "id", "left")
    return rows.select("id", "title", sold).orderBy(F.desc("sold_count"), "id").limit(limit)


def document_phrases(m: Market, words: tuple[str, ...] = ("ation", "ment")) -> DataFrame:
    """Documents whose text holds all of the words, found by an index over all texts in lower case."""
    docs = m.raw("documents").select("doc_id", F.lower("text").alias("text"))
    return containing(docs, list(words), build_index(docs, "doc_id", "text"), "doc_id", "text").select("doc_id")
