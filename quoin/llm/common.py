"""Helpers shared by the text operators: stored stages, inputs by name, and word handling."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.sources.stored import shared_dir as shared_dir
from quoin.sources.stored import store as store

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch, where the session doesn't set its own: a worker holds few long texts at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches are bounded by rows and bytes, where the session doesn't set its own bounds."""
    for key in BATCHES.keys() - spark.conf.getAll.keys():
        spark.conf.set(key, BATCHES[key])


def in_batches(df: DataFrame, make: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow over batches bounded by rows and bytes. A single row is never cut, however long it is."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(make, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def without_ids(docs: DataFrame, gone: DataFrame, id_column: str = "doc_id", broadcast_ids: int = 1_000_000) -> DataFrame:
    """docs but for the ids in gone, a stored table. It is broadcast if it has at most broadcast_ids rows; rows with null ids
    stay."""
    few = gone.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone, id_column, "left_anti")
