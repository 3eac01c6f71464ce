"""Connected components by joins, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import dropped, written


def components(edges: DataFrame, nodes: DataFrame, *, start: DataFrame | None = None) -> DataFrame:
    """node, root and root_rank of every node of `edges` (a, b): the root is the reachable node of least (rank, node).

    nodes: node and rank of all nodes that occur. start: labels to begin with (node, root, root_rank), of an
    earlier call over some of the edges. Each round takes the least label of the neighbours and then the
    label of one's root, so paths shorten by half; it ends with a round that changes nothing.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    own = F.struct(F.col("rank").alias("rank"), F.col("node").alias("node"))
    if start is None:
        labels = nodes.join(both.select(F.col("a").alias("node")).distinct(), "node").select("node", own.alias("label"))
    else:
        known = start.select("node", F.struct(F.col("root_rank").alias("rank"), F.col("root").alias("node")).alias("known"))
        labels = nodes.join(known, "node", "left").select("node", F.coalesce("known", own).alias("label"))
    held = labels = written(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        roots = labels.select("node", F.col("label.node").alias("root"), "label")
        # A root takes the least label that any of its members has met.
        met = roots.join(near, roots.node == near.a).groupBy("root").agg(F.min("near").alias("met"))
        step = roots.join(met, "root", "left").select("node", "label", F.coalesce(F.least("label", "met"), "label").alias("new"))
        jump = step.select(F.col("node").alias("via"), F.col("new").alias("far"))
        after = step.join(jump, F.col("new.node") == jump.via, "left").select("node", "label", F.coalesce(F.least("new", "far"), "new").alias("new"))
        after = written(after, "labels")
        dropped(edges.sparkSession, held)
        held, labels = after, after.select("node", F.col("new").alias("label"))
        if after.where(F.col("new") != F.col("label")).isEmpty():
            dropped(edges.sparkSession, both)
            return labels.select("node", F.col("label.node").alias("root"), F.col("label.rank").alias("root_rank"))
