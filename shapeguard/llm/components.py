"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeguard.llm.common import cut, looked_up


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: longs); label is the least node reachable.

    Each round takes the least label among a node's neighbours, moves it on to
    what the node's own label pointed at, and then replaces labels by their labels'
    labels. Minima combine before the shuffle; a node with very many links and a label
    with very many nodes are looked up in a broadcast table of bounded size, so no task
    holds a hub or a large component. Every round is a table in the shared folder, so lost
    executors cost one round at most. Labels only fall, and rounds grow with the logarithm
    of the longest path, so it ends.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = cut(both.distinct(), "links")
    labels = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    n_edges, n_nodes = edges.count(), labels.count()
    while True:
        at_other = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        near = looked_up(edges, at_other, "b", n_edges).groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = cut(labels.join(near, "node").withColumn("new", F.least("label", "seen")), "lower")
        hooks = lower.where("new < label").groupBy(F.col("label").alias("node")).agg(F.min("new").alias("hook"))
        moved = cut(lower.join(hooks, "node", "left").select("node", "label", F.least("new", F.coalesce("hook", "new")).alias("new")), "moved")
        up = moved.select(F.col("node").alias("new"), F.col("new").alias("up"))
        jumped = looked_up(moved, up, "new", n_nodes)  # every label is a node
        after = cut(jumped.select("node", F.least("new", "up").alias("next"), F.col("label").alias("was")), "labels")
        labels = after.select("node", F.col("next").alias("label"))
        if after.where("next <> was").isEmpty():
            return labels
