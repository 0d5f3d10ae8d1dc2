"""Connected components of a graph in a DataFrame; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.storage import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b: long), the component's smallest node standing for it.

    Each round gives every node the least label in its neighbourhood, then hops from label to label's label, so
    chains shorten by a constant factor. Labels and edges are written to the shared folder in each round; the
    minimum is combined before the shuffle, so a node with very many neighbours is no burden. Edges whose ends
    have the same label are dropped between rounds, as they can't change anything any more: an edge is replaced by
    the edge of its ends' labels (contraction). Empty edges give an empty result.
    """
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).union(edges.select(F.col("a"), F.col("a")))
    labels = materialise(ends.groupBy("node").agg(F.min("to").alias("label")), "labels")
    for _ in range(rounds):
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = edges.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialise(edges, "edges")
        # a root may hang below the least root next to it; then labels hop twice
        hang = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        nodes = labels.join(hang.withColumnsRenamed({"node": "label", "up": "up1"}), "label", "left").select("node", F.coalesce("up1", "label").alias("label"))
        nodes = materialise(nodes, "labels")
        up = nodes.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = materialise(nodes.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        if edges.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
