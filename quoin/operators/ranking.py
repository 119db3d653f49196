"""Ranks and running sums in one order over all rows, without a task that holds them all.

Rows are dealt to range partitions and sorted there; a row's rank is its place in its partition plus the rows of the partitions
before it. Only the partitions' totals, a row for each, meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.sources.stored import store

#: Within a partition monotonically_increasing_id counts in the lower bits.
PLACE_BITS = 33


def in_ranges(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows as a stored table, with the range partition (``range_part``) that holds each and its place there from 0 (``range_place``)."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("in_range", F.monotonically_increasing_id())
    stored = store(ranged, name)
    return stored.withColumns({"range_part": F.shiftright("in_range", PLACE_BITS), "range_place": F.col("in_range").bitwiseAND((1 << PLACE_BITS) - 1)}).drop("in_range")


def with_serials(rows: DataFrame, order: list[str], name: str = "serial", base: Column | int = 0) -> DataFrame:
    """rows with gapless numbers from base + 1 in the order of ``order``. Rows that are equal there get different numbers, in any order;
    nulls come first. An empty table stays empty."""
    ranged = in_ranges(rows, order, "serials")
    before = Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = ranged.groupBy("range_part").agg(F.count("*").alias("n")).select("range_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_offset"))
    base = base if isinstance(base, Column) else F.lit(base)
    return ranged.join(F.broadcast(offsets), "range_part").withColumn(name, (base + F.col("range_offset") + F.col("range_place") + 1).cast("long")).drop("range_part", "range_place", "range_offset")


def running_sums(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], hot_rows: int = 1_000_000, count: int | None = None) -> DataFrame:
    """rows with running sums of whole numbers over each key's rows in the order of ``order`` (unique in a key), the row itself
    included; nulls add nothing. rows is a stored table: keys with more than hot_rows rows are looked for first, and dealt to
    range partitions, whose sums are carried from one to the next; the others are sums over a window each. ``count``: how many
    rows there are, if that is known."""
    local = lambda df, *by: df.withColumns({n: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) for n, c in sums.items()})
    if (rows.count() if count is None else count) <= hot_rows:
        return local(rows, key)
    hot = store(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select(F.col(key).alias("hot_key")), "hot_keys")
    if hot.isEmpty():
        return local(rows, key)
    is_hot = F.col(key).eqNullSafe(F.col("hot_key"))  # at most a row for each hot_rows rows
    ranged = local(in_ranges(rows.join(F.broadcast(hot), is_hot, "left_semi"), [key, *order], "hot_rows"), "range_part", key)
    totals = ranged.groupBy("range_part", F.col(key).alias("hot_key")).agg(*[F.max_by(n, "range_place").alias(f"{n}_total") for n in sums])
    before = Window.partitionBy("hot_key").orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = totals.select(F.col("range_part").alias("of"), "hot_key", *[F.coalesce(F.sum(f"{n}_total").over(before), F.lit(0)).alias(f"{n}_before") for n in sums])
    met = ranged.join(F.broadcast(carried), (F.col("range_part") == F.col("of")) & is_hot)
    whole = met.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums}).select(*rows.columns, *sums)
    return local(rows.join(F.broadcast(hot), is_hot, "left_anti"), key).unionByName(whole)


def components(links: DataFrame, node: str, via: str) -> DataFrame:
    """(node, component) for every node of links (node, via; neither null): the smallest node that it is connected with through shared
    ``via``. Each round takes the least label over neighbours and then that label's own, so paths take few rounds; every round
    is a stored table."""
    edges = store(links.select(F.col(node).alias("node"), F.col(via).alias("via")).distinct(), "links")
    labels = store(edges.select("node", F.col("node").alias("component")).distinct(), "labels")
    while True:
        least = edges.join(labels, "node").groupBy("via").agg(F.min("component").alias("least"))
        near = edges.join(least, "via").groupBy("node").agg(F.min("least").alias("least"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("label"))
        hooks = lower.groupBy(F.col("was").alias("label")).agg(F.min("label").alias("to"))  # what a whole class has found
        jumped = lower.join(hooks.withColumnsRenamed({"label": "was", "to": "found"}), "was").select("node", "was", F.least("label", "found").alias("label"))
        moved = store(jumped.join(hooks, "label", "left").select("node", F.least("label", "to").alias("component"), "was"), "labels")
        if moved.filter("component <> was").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
