"""How filters overlap: what each would remove, and lose of what labels say, in every order and after every other.

What a filter removes depends only on the set of filters before it, not on their order. So each partition becomes a packed
bitmap index: its rows are put in runs by part, and each run has a NumPy bitset for every filter and label. For each
prefix subset the rows that are left are the AND-NOT of its filters, and popcounts with the next filter and the labels are
summed over partitions. Orders, redundancy, unique failures and Shapley sums follow from these few sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import WORD, store, table

#: Rows that become bitsets at once.
BLOCK = 1 << 18
#: A text that this share of all rows have is common; there are at most 1 / COMMON of them.
COMMON = 0.001


def count_prefixes(flags: np.ndarray, filters: int) -> np.ndarray:
    """flags: rows x (filters, then labels). For each prefix subset (bits) and each filter outside of it: subset, filter, rows kept,
    rows removed, and the removed ones with each label."""
    bits = np.packbits(flags, axis=0).T.copy()
    fails, labels = bits[:filters], bits[filters:]
    ones = lambda x: int(np.bitwise_count(x).sum())
    left, out = {0: np.packbits(np.ones(len(flags), bool))}, []
    for prefix in range(1 << filters):
        if prefix:
            last = prefix.bit_length() - 1
            left[prefix] = left[prefix ^ (1 << last)] & ~fails[last]
        before = ones(left[prefix])
        for k in range(filters):
            if not prefix >> k & 1:
                hit = left[prefix] & fails[k]
                removed = ones(hit)
                out.append((prefix, k, before - removed, removed, *(ones(hit & x) for x in labels)))
    return np.array(out, np.int64)


def prefix_sums(rows: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """For each part, prefix subset (a number with bit k for filters[k]) and filter outside of it: kept, removed, and the removed rows
    of each label as lost_<label>. rows has a boolean column for each filter (true: fails) and label; nulls are false, and a
    null part is the empty one. An empty table gives no rows."""
    names = ["part", "prefix", "k", "kept", "removed", *(f"lost_{x}" for x in labels)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_rows = pa.Table.from_batches(held).combine_chunks()
            parts = all_rows["part"].combine_chunks().dictionary_encode()
            parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
            codes = parts.indices.to_numpy(zero_copy_only=False)
            flags = np.stack([all_rows[c].to_numpy() for c in [*filters, *labels]], axis=1).astype(bool)
            order = np.argsort(codes, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                found = count_prefixes(flags[run], len(filters))
                name = pa.array([parts.dictionary[int(codes[run[0]])].as_py()] * len(found), pa.string())
                yield pa.RecordBatch.from_arrays([name, *(pa.array(c) for c in found.T)], names=names)

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                yield from counted(held)
                held, n = [], 0
        if held:
            yield from counted(held)

    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c)
    given = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *map(flag, [*filters, *labels]))
    sums = given.mapInArrow(index, ", ".join(f"{c} {'string' if c == 'part' else 'long'}" for c in names)).groupBy("part", "prefix", "k")
    return sums.agg(*[F.sum(c).alias(c) for c in names[3:]])


def all_orders(sums: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    lost_<label>..., shapley. sums comes from prefix_sums; there are as many orders as the factorial of the filters."""
    n = len(filters)
    asked = [("".join(filters[k] for k in order), step + 1, sum(1 << k for k in order[:step]), order[step]) for order in permutations(range(n)) for step in range(n)]
    steps = sums.sparkSession.createDataFrame(asked, "filter_order string, step int, prefix long, k long")
    own = Window.partitionBy("part", "k")
    weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)]), F.bit_count("prefix") + 1)
    at = lambda subset: F.sum(F.when(F.col("prefix") == subset, F.col("removed"))).over(own)
    rest = F.element_at(F.array(*[F.lit((1 << n) - 1 - (1 << k)) for k in range(n)]), (F.col("k") + 1).cast("int"))
    rows = sums.withColumns({"failing": at(0), "unique_fails": at(rest), "shapley": F.sum(F.col("removed") * weight).over(own)})
    lost = [f"lost_{x}" for x in labels]
    return rows.join(F.broadcast(steps), ["prefix", "k"]).select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")


def with_repeats(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """A stored table with a column that says whether a row with the same key has a smaller ``order``; null orders are smaller than
    none and have no smaller ones. Keys of a thousandth of all rows or more are at most a thousand and are broadcast, so
    no task gets more than such a share of one key."""
    groups = store(rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeats")
    common = groups.filter(F.col("n") >= COMMON * rows.count()).select(key, "first")
    rare = groups.join(F.broadcast(common.select(key)), key, "left_anti").select(key, "first")
    judged = lambda part, firsts: part.join(firsts, key, "left").withColumn(name, F.coalesce(F.col("first") < F.col(order), F.lit(False))).drop("first")
    here = rows.join(F.broadcast(common.select(key)), key, "left_semi")
    return judged(here, F.broadcast(common)).unionByName(judged(rows.join(F.broadcast(common.select(key)), key, "left_anti"), rare))


FILTERS, LABELS = list("ABCDE"), ["good", "toxic"]


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and whether it fails A (under 100 words), B (under 80 distinct words in 100), C (over ten
    capitals A-Z in 100 code points) and D (any of #$%&*|). A null text is an empty one: it fails A alone."""
    text = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    words = text.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    many, distinct = F.size("w"), F.size(F.array_distinct("w"))
    fails = [many < 100, 100 * distinct < 80 * many, 100 * F.regexp_count("t", F.lit("[A-Z]")) > 10 * F.length("t"), F.col("t").rlike(r"[#$%&*|]")]
    return words.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *[c.alias(x) for c, x in zip(fails, FILTERS, strict=False)])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents by language, in all 120 orders. E fails a text that a smaller doc_id has too, whatever
    was removed. A label counts for a doc_id if any of its label rows says 1; rows that repeat a doc_id are each counted."""
    rows = with_repeats(store(failures(docs), "failures"), "digest", "doc_id", "E")
    said = labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    found = rows.join(said, "doc_id", "left")
    orders = all_orders(store(prefix_sums(found, FILTERS, LABELS), "prefixes"), FILTERS, LABELS)
    return orders.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ORDERS = ", ".join(f"('{''.join(x)}')" for x in permutations(FILTERS))
#: The same rows with each document's own failures at every step of every order.
ORACLE_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), said AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), rows AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {{
      'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t),
      'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)}} AS fails
  FROM texts d LEFT JOIN said USING (doc_id)
), kinds AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM rows GROUP BY ALL
), steps AS (
  SELECT o AS filter_order, s::INTEGER AS step, o[s:s] AS f, o[1:s - 1] AS earlier, o[1:s] AS until FROM (VALUES {_ORDERS}) v(o), range(1, 6) r(s)
), judged AS (
  SELECT k.*, filter_order, step, f, struct_extract(x, 'now') AS now, struct_extract(x, 'gone') AS gone, struct_extract(x, 'others') AS others FROM kinds k, steps,
    LATERAL (SELECT {{'now': CASE f WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END,
      'gone': fails.A AND contains(earlier, 'A') OR fails.B AND contains(earlier, 'B') OR fails.C AND contains(earlier, 'C') OR fails.D AND contains(earlier, 'D') OR fails.E AND contains(earlier, 'E'),
      'others': fails.A AND f <> 'A' OR fails.B AND f <> 'B' OR fails.C AND f <> 'C' OR fails.D AND f <> 'D' OR fails.E AND f <> 'E'}} AS x)
), counts AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT now AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (now AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (now AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (now AND NOT others), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (now AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (now AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counts
"""
