"""Connected components by label propagation with pointer jumping; every round is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import store


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that it is connected with.

    A round takes the least label among neighbours, which partial aggregation reduces before the shuffle, then the label of
    that label, so long paths take a logarithmic number of rounds. Empty links give an empty table.
    """
    edges = store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = store(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        lower = labels.join(near, "node").select("node", F.least("component", "least").alias("label"), F.col("component").alias("was"))
        above = labels.select(F.col("node").alias("label"), F.col("component").alias("jump"))
        moved = store(lower.join(above, "label", "left").select("node", F.least("label", "jump").alias("component"), "was"), "labels")
        if moved.filter("component <> was").limit(1).count() == 0:
            return moved.select("node", "component")
        labels = moved.select("node", "component")
