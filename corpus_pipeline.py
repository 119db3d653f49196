"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Toxic documents go, one document of each class of near duplicates stays, documents with benchmark passages go, personal data
are replaced by their kinds, and what is left is packed into sequences. Every stage works on all rows that the stage
before it kept. Rows with null ids or texts are kept by all filters; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.best_fit import pack_best_fit
from quoin.llm.common import store, table, without_ids
from quoin.llm.decontaminate import find_passages
from quoin.llm.ngram_join import without_near_duplicates
from quoin.llm.pii import fit_trees, redact
from quoin.llm.toxicity import fit_grammar, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    grammar = fit_grammar(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, grammar).filter("toxicity < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked rows the one with the smallest id; rows that repeat an id are judged by their own texts."""
    return without_near_duplicates(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = store(find_passages(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return without_ids(docs, found).select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by their kinds; n_chars is that of the new text."""
    clean = redact(docs.select(*COLUMNS), model=fit_trees(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there."""
    return pack_best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("best_fit_packing", pack),
]
#: Trained scores and packing are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
