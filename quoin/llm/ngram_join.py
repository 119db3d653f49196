"""Exact Jaccard join on word shingles with vertical partitioning, and classes of linked documents.

Equal sets are first reduced to one. Then, without counting anything globally, documents that cannot have a partner are
dropped: in the order of the shingles' hashes two linked sets share several of their first shingles (a prefix of
about three tenths), so a document stays only if as many of its prefix occur in another prefix. For the others
shingles get their global order (rare ones first) and the usual prefix filter gives candidates. The order is cut into
fragments at pivots; each fragment counts the partial overlaps of candidate pairs, and the sum per pair decides.

A bucket of the prefix filter never emits all its pairs. First each bucket pairs its documents with one leader, the
one with the fewest unshared shingles; this joins most large groups of near copies. Afterwards only pairs from
different components are candidates, so no link between different components is missed and none inside one is needed.
A pair is only made if the parities of both sets' shingles over ``PARITIES`` bits differ in no more places than a linked
pair's may, which drops most pairs of texts that share stock passages; buckets with many documents outside their
largest component are dealt over several tasks.

Sets are known by a number of their own, not by doc_id, so rows that repeat a doc_id are each judged by their text.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import in_batches, store, table, without_ids
from quoin.llm.components import connected_components
from quoin.llm.shingles import mix, shingle_sets

#: Documents whose ids may be broadcast to pick their texts; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Bits of the parity sketch; documents of one bucket outside its largest component that one task takes.
PARITIES, SPLIT = 1024, 4096


def least_overlap(n: Column) -> Column:
    """Of a set of n, shingles shared with any linked set: at least four fifths, rounded up."""
    return F.ceil(n * 4 / 5).cast("int")


def _ninths(a: str, b: str) -> Column:
    """100 * overlap >= 80 * union, for sets of a and b: the least overlap."""
    return F.ceil((F.col(a) + F.col(b)) * 4 / 9).cast("int")


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two sums over mixed hashes, by which equal sets are known."""
    if not len(s):
        return 0, 0
    u = s.view(np.uint64)
    return int(u.sum().view(np.int64)), int(mix(u + np.uint64(0x51ED27)).sum().view(np.int64))


def parities(s: np.ndarray) -> np.ndarray:
    """For each of PARITIES bits whether an odd number of the shingles fall on it, as 64-bit numbers."""
    odd = (np.bincount((s & (PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0] + [len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), two digests of the set, and the prefix in the order of hashes."""
    out = "doc_id long, n int, d1 long, d2 long, prefix array<long>"

    def make(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            one, two = zip(*map(digests, sets), strict=True) if sets else ((), ())
            heads = [s[: len(s) - -(-4 * len(s) // 5) + -(-len(s) // 10)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists(heads)], names=[c.split()[0] for c in out.split(", ")])

    return in_batches(docs, make, out)


def with_digests(docs: DataFrame, text: str) -> DataFrame:
    """docs and set_n, set_d1, set_d2 of each text's set."""

    def make(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(text).cast(pa.string())))
            one, two = zip(*map(digests, sets), strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, sets), pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=[*batch.schema.names, "set_n", "set_d1", "set_d2"])

    return in_batches(docs, make, T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in (("set_n", T.IntegerType()), ("set_d1", T.LongType()), ("set_d2", T.LongType())))]))


def full_sets(docs: DataFrame) -> DataFrame:
    out = "doc_id long, n int, d1 long, d2 long, bits array<long>, shingles array<long>"

    def make(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            one, two = zip(*map(digests, sets), strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists([parities(s) for s in sets]), lists(sets)], names=[c.split()[0] for c in out.split(", ")])

    return in_batches(docs, make, out)


def possible(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """The reps whose prefix shares enough with others' prefixes. Prefixes are counted by doc_id: if rows with different texts
    repeat one, their counts add up and too many are kept, never too few."""
    tokens = sets.filter("n > 0").select("doc_id", "n", F.explode("prefix").alias("shingle"))
    shared = store(tokens.groupBy("shingle").count().filter("count > 1").select("shingle"), "shared")
    enough = F.ceil(least_overlap(F.col("n")) / 10)
    found = tokens.join(shared, "shingle").groupBy("doc_id", "n").count().filter(F.col("count") >= enough).select(F.col("doc_id").alias("rep"), "n").distinct()
    return reps.join(found, ["rep", "n"], "left_semi")


def ordered(sets: DataFrame, fragments: int) -> tuple[DataFrame, list[float]]:
    """node, n, m (shingles that another set has too), and these in the global order as (df, shingle); pivots that cut
    the order into fragments of about as many occurrences. Sets with fewer than four fifths shared are left out."""
    tokens = sets.select("node", "n", F.explode("shingles").alias("shingle"))
    counts = store(tokens.groupBy("shingle").agg(F.count("*").cast("int").alias("df")).filter("df > 1"), "counts")
    lists = tokens.join(counts, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("order"))  # no longer than one document
    kept = store(lists.withColumn("m", F.size("order")).filter(F.col("m") >= least_overlap(F.col("n"))), "ordered")
    cuts = [k / fragments for k in range(1, fragments)]
    pivots = kept.select(F.explode("order").alias("e")).select(_key(F.col("e")).alias("key")).approxQuantile("key", cuts, 0.01)
    return kept, sorted(set(pivots))


def _key(entry: Column) -> Column:
    """A number that never falls along the global order and is the same for the same shingle."""
    return entry["df"] + entry["shingle"] / F.lit(float(2**65)) + 0.5


def segments(sets: DataFrame, pivots: list[float]) -> DataFrame:
    """node, fragment, shingles: each set's non-empty parts by fragment."""
    part = lambda low, high: F.transform(F.filter("order", lambda e: (F.lit(True) if low is None else _key(e) >= low) & (F.lit(True) if high is None else _key(e) < high)), lambda e: e["shingle"])
    edges = [None, *pivots, None]
    parts = F.array(*[part(a, b) for a, b in zip(edges, edges[1:], strict=False)])
    return sets.select("node", F.posexplode(parts).alias("fragment", "shingles")).filter(F.size("shingles") > 0)


def verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The linked of pairs (a, b, need): partial overlaps counted by fragment, summed per pair."""
    one = pairs.join(parts.select(F.col("node").alias("a"), "fragment", F.col("shingles").alias("x")), "a")
    both = one.join(parts.select(F.col("node").alias("b"), "fragment", F.col("shingles").alias("y")), ["b", "fragment"])
    partial = both.select("a", "b", "need", F.size(F.array_intersect("x", "y")).alias("overlap"))
    return partial.groupBy("a", "b", "need").agg(F.sum("overlap").alias("overlap")).filter("overlap >= need").select("a", "b")


def _pair(left: str, right: str) -> list[Column]:
    return [F.least(f"{left}.node", f"{right}.node").alias("a"), F.greatest(f"{left}.node", f"{right}.node").alias("b"), _ninths(f"{left}.n", f"{right}.n").alias("need")]


def _may_link(left: str, right: str) -> Column:
    """By size, by how many shingles can be shared, and by how many are left behind the common one."""
    need = _ninths(f"{left}.n", f"{right}.n")
    return (F.least(f"{left}.m", f"{right}.m") >= need) & (F.least(F.col(f"{left}.m") - F.col(f"{left}.at"), F.col(f"{right}.m") - F.col(f"{right}.at")) >= need)


def _parities_allow(left: str, right: str) -> Column:
    """Each bit in which the parities differ stands for a shingle that only one of the sets has."""
    differ = reduce(add, [F.bit_count(F.col(f"{left}.bits")[k].bitwiseXOR(F.col(f"{right}.bits")[k])) for k in range(PARITIES // 64)])
    return differ <= F.col(f"{left}.n") + F.col(f"{right}.n") - 2 * _ninths(f"{left}.n", f"{right}.n")


def across_components(buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, need): the pairs of one bucket, from different components, that may link."""
    labelled = buckets.select("shingle", "d", F.col("d.node").alias("node")).join(labels, "node", "left").select("shingle", "d", F.coalesce("component", "node").alias("c"))
    labelled = store(labelled, "labelled")
    sizes = labelled.groupBy("shingle", "c").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("shingle").agg(F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("k"), F.count("*").alias("cs")).filter("cs > 1")
    mixed = store(mixed.select("shingle", F.col("most.c").alias("major"), F.ceil((F.col("k") - F.col("most.k")) / SPLIT).cast("int").alias("splits")), "mixed")
    inside = labelled.join(mixed, "shingle").select("shingle", "c", "major", "splits", F.col("d.node").alias("node"), F.col("d.m").alias("m"), F.col("d.at").alias("at"))
    inside = store(inside.join(sets.select("node", "n", "bits"), "node").select("shingle", "c", "major", "splits", F.struct("node", "n", "m", "at", "bits").alias("d")), "inside")
    minor = inside.filter("c <> major").select("shingle", F.pmod(F.xxhash64("d.node"), "splits").alias("salt"), F.col("d").alias("e"), F.col("c").alias("ec"))
    dealt = inside.select("shingle", "d", "c", "major", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits").cast("long") - 1)).alias("salt"))
    other = (F.col("c") != F.col("ec")) & ((F.col("c") == F.col("major")) | (F.col("d.node") < F.col("e.node")))
    return dealt.join(minor, ["shingle", "salt"]).filter(other & _may_link("d", "e") & _parities_allow("d", "e")).select(*_pair("d", "e")).distinct()


def link_components(sets: DataFrame, fragments: int = 8) -> DataFrame:
    """(node, component) of all in sets (node, n, bits, shingles) that have a link."""
    kept, pivots = ordered(sets, fragments)
    parts = store(segments(kept, pivots), "segments")
    head = F.slice("order", 1, F.col("m") - least_overlap(F.col("n")) + 1)
    buckets = kept.select("node", "n", "m", F.posexplode(F.transform(head, lambda e: e["shingle"])).alias("at", "shingle"))
    buckets = store(buckets.select("shingle", F.struct("node", "n", "m", "at").alias("d")), "buckets")
    leaders = store(buckets.groupBy("shingle").agg(F.min(F.struct((F.col("d.n") - F.col("d.m")).alias("u"), F.col("d"))).alias("l"), F.count("*").alias("c")).filter("c > 1").select("shingle", F.col("l.d").alias("l")), "leaders")
    first = buckets.join(leaders, "shingle").filter(F.col("d.node") != F.col("l.node")).filter(_may_link("d", "l")).select(*_pair("d", "l")).distinct()
    links = store(verified(store(first, "pairs"), parts), "links")
    labels = connected_components(links)
    second = store(across_components(buckets, labels, sets), "pairs")
    if second.isEmpty():
        return labels
    more = store(verified(second, parts), "links")
    if more.isEmpty():
        return labels
    lift = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    lifted = more.join(lift, "a", "left").select(F.coalesce("ca", "a").alias("a"), "b").join(lift.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left").select("a", F.coalesce("cb", "b").alias("b"))
    above = connected_components(lifted)
    nodes = labels.unionByName(above.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return nodes.join(above.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def classified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fragments: int = 8) -> DataFrame:
    """For every row of docs: doc_id, n, d1, d2 (its set), component_id, and whether its set stands for its component: the one
    with the smallest doc_id, then with the smallest n, d1 and d2."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = store(sketch(rows), "sets")
    reps = store(sets.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "reps")
    chosen = store(possible(sets, reps), "possible")
    few = chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    picked = F.broadcast(chosen) if few else chosen
    texts = rows.join(picked.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = full_sets(texts).join(picked.select(F.col("rep").alias("doc_id"), "n", "d1", "d2", "node"), ["doc_id", "n", "d1", "d2"]).dropDuplicates(["node"])
    linked = store(link_components(store(found.select("node", "n", "bits", "shingles"), "full_sets"), fragments), "linked")
    members = reps.join(linked, "node").select("component", "n", "d1", "d2", "rep")
    best = members.groupBy("component").agg(F.min(F.struct("rep", "n", "d1", "d2")).alias("best"))
    least = members.select("component", "n", "d1", "d2").join(best, "component").select("n", "d1", "d2", F.col("best.rep").alias("least"), F.struct("n", "d1", "d2").eqNullSafe(F.struct("best.n", "best.d1", "best.d2")).alias("stands"))
    classes = reps.join(least, ["n", "d1", "d2"], "left").select("n", "d1", "d2", F.coalesce("least", "rep").alias("component"), F.coalesce("stands", F.lit(True)).alias("stands"))
    out = sets.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
    return out.select("doc_id", "n", "d1", "d2", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("stands", F.lit(True)).alias("stands"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fragments: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: the size of its set of five-word shingles, and the smallest
    doc_id reachable by links of similarity 0.8 or more.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with equal texts are linked; rows that
    repeat a doc_id are each judged by their own text. Null ids stay null and lead to no class.
    """
    return classified(docs, doc_id, text, fragments).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of linked rows: that with the smallest doc_id, and of rows that repeat it with linked texts one.

    Rows without shingles or with null ids stay, all of them; so do rows that repeat a doc_id with texts that aren't linked. Only
    rows whose doc_id repeats are known by their text's digests; all others go by doc_id.
    """
    rows = store(classified(docs, doc_id, text), "classes").filter("doc_id is not null")
    stays = F.col("stands") & (F.col("doc_id") == F.col("component_id")) | (F.col("n") == 0)
    twice = store(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated_ids")
    id_type = docs.schema[doc_id].dataType
    gone = store(rows.filter(~stays).join(twice, "doc_id", "left_anti").select(F.col("doc_id").cast(id_type).alias(doc_id)), "gone")
    if twice.isEmpty():
        return without_ids(docs, gone, doc_id)
    repeated = twice.select(F.col("doc_id").cast(id_type).alias(doc_id))
    once = without_ids(docs, store(gone.unionByName(repeated), "gone"), doc_id)
    kept = rows.filter(stays & (F.col("n") > 0)).join(twice, "doc_id").select(F.col("doc_id").cast(id_type).alias("set_id"), F.col("n").alias("set_n"), F.col("d1").alias("set_d1"), F.col("d2").alias("set_d2")).distinct()
    key = ["set_id", "set_n", "set_d1", "set_d2"]
    whole = docs.join(repeated, doc_id, "left_semi").select(F.struct("*").alias("row"), F.col(doc_id).alias("set_id"), F.col(text).alias("set_text"))
    more = with_digests(whole, "set_text")
    more = more.filter("set_n = 0").unionByName(more.filter("set_n > 0").dropDuplicates(key).join(kept, key, "left_semi"))
    return once.unionByName(more.select("row.*"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same rows by counting the shared shingles of all pairs and following links; for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS node, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), lists AS (
  SELECT node, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts
), words AS (
  SELECT node, unnest(w) AS word, generate_subscripts(w, 1) AS place, len(w) AS many FROM lists
), runs AS (
  SELECT node, place, many, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
  FROM words WINDOW o AS (PARTITION BY node ORDER BY place)
), shingles AS (
  SELECT DISTINCT node, shingle FROM runs WHERE place <= greatest(many - 4, 1)
), sizes AS (
  SELECT node, count(*) AS n FROM shingles GROUP BY node
), shared AS (
  SELECT a.node AS x, b.node AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node < b.node GROUP BY a.node, b.node
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.node = x JOIN sizes q ON q.node = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT node, node AS other FROM texts
  UNION
  SELECT r.node, e.y FROM reached r JOIN edges e ON e.x = r.other
), classes AS (
  SELECT r.node, min(t.doc_id) AS component_id FROM reached r JOIN texts t ON t.node = r.other GROUP BY r.node
)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM texts t JOIN classes c ON c.node = t.node LEFT JOIN sizes s ON s.node = t.node
"""
