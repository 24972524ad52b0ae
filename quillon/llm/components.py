"""Connected components over an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import discard, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of `edges` (u, v); root is the smallest node reachable.

    Every round takes the least label among neighbours (a partially aggregated
    minimum, so a hub needs no task of its own) and then the label of that
    label, which halves paths. Labels are written to the shared folder each
    round and those of the round before are deleted. An empty edge table gives
    an empty result; self loops and repeated edges change nothing.
    """
    both = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")).withColumn("old", F.col("node")), f"{name}-labels")
    while not labels.filter("old <> root").isEmpty():
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        least = labels.select("node", "root").join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        moved = stored(least.join(jump, "to", "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("root"), F.col("root").alias("old")), f"{name}-labels")
        discard(labels)
        labels = moved
    discard(both)
    return labels.select("node", "root")
