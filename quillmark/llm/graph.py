"""Connected components over a table of edges, without a graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed, discard, unestimated

#: Nodes that one partition of labels holds: rounds are many, and each writes a file for each partition.
NODES = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so the
    number of rounds is about the logarithm of the longest path. Rounds are checkpointed, in as many partitions as the
    number of nodes asks for, and read without an estimate of their size (see ``unestimated``).
    Nulls are no nodes: an edge with one is left out, as is an edge from a node to itself; edges may repeat. No edges give no rows. Other columns of edges are not read.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges_kept = checkpointed(both)
    both = unestimated(edges_kept)
    kept = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    labels = unestimated(kept)
    parts = -(-labels.count() // NODES) or 1
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("near_node")).agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.near_node).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        following = checkpointed(step.join(jump, step.label == jump["at"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")).coalesce(parts))
        discard(kept)
        kept, following = following, unestimated(following)
        moved = following.filter("label <> old").limit(1).count()
        labels = following.select("node", "label")
        if not moved:
            discard(edges_kept)
            return labels
