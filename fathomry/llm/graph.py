"""Connected components by label propagation with pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label (smallest node reachable) for the nodes of edges (a, b); each round's labels are written out."""
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        new = scratch.save(low.join(up, "low", "left").select("node", F.least("low", F.coalesce("top", "low")).alias("label"), F.col("label").alias("old")), f"{name}-{turn}")
        scratch.discard(f"{name}-{turn - 1}")
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels
