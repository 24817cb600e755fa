"""Connected components of an edge table by contraction with pointer jumping; every round is written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the smallest node of each component. Self loops are components of one node.

    Each round every node takes the smallest label among its own and its neighbours', and labels are followed once, so
    that long chains need few rounds. Null ends are left out.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = materialise(both.union(both.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("m"))
        near = labels.join(seen, labels.node == seen.a, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("next"), "component")
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("above"))
        moved = near.join(up, "next", "left").select("node", F.least("next", F.coalesce("above", "next")).alias("fresh"), "component")
        moved = materialise(moved, "labels")
        labels = moved.select("node", F.col("fresh").alias("component"))
        if moved.where("fresh <> component").isEmpty():
            return labels
