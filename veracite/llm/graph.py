"""Connected components of a graph whose nodes have few neighbours, with tables written between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace


def components(ws: Workspace, edges: DataFrame, name: str = "graph") -> DataFrame:
    """(node, label): for each node of edges (a, b: long, not null), the smallest node that it reaches.

    Each round takes the least label among a node's neighbours, then the label of that label, so labels travel over
    doubling distances. It ends when a whole round changes nothing. A label that many nodes share is a hot key only
    of the last join, whose sides are both written tables, so that adaptive execution can split it.
    """
    both = ws.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-both")
    labels = ws.table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}-labels0")
    k = 0
    while True:
        k += 1
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("told"))
        near = labels.join(told, labels["node"] == told["a"]).select("node", F.least("label", "told").alias("near"), F.col("label").alias("old"))
        near = ws.table(near, f"{name}-near{k}")
        far = near.select(F.col("node").alias("at"), F.col("near").alias("far"))
        nxt = near.join(far, near["near"] == far["at"]).select("node", F.col("far").alias("label"), (F.col("far") != F.col("old")).alias("moved"))
        nxt = ws.table(nxt, f"{name}-labels{k}")
        done = nxt.where("moved").isEmpty()
        labels = nxt.select("node", "label")
        ws.drop(f"{name}-near{k}")
        ws.drop(f"{name}-labels{k - 1}")
        if done:
            return labels
