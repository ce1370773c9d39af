"""Connected components of an edge table, by rounds of minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, join_by_weight, write_table


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``edges`` has two bigint columns a and b; returns (node, component), the smallest node that each one reaches.

    Nodes without an edge to another node do not appear. Each round takes the smallest label among the neighbours,
    summed up before the shuffle, then jumps to the label of the label; labels halve the distance that is left, so
    rounds grow with the logarithm of the longest shortest path. A round's labels are a written table. Nulls, loops
    and repeated edges are ignored. Nodes of many edges and labels of many nodes join by weight, so none of them gathers in
    one task.
    """
    both = edges.where("a <> b").select("a", "b")
    both = write_table(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = both.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree"))
    labels = write_table(labels, "labels")
    nodes = labels.count()
    for _ in range(max_rounds):
        told = join_by_weight(both, labels.select(F.col("node").alias("b"), "label", "degree"), ["b"], "degree", total)
        near = told.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        # the label of the old label: what the representative has learnt meanwhile
        step = write_table(labels.join(near, "node").select("node", "degree", "label", F.least("label", "seen").alias("new")), "steps")
        hooks = step.groupBy("label").agg(F.min("new").alias("low"), F.count(F.lit(1)).alias("members"))
        jump = write_table(join_by_weight(step, hooks, ["label"], "members", nodes).select("node", "degree", "label", F.least("new", "low").alias("new")), "labels")
        changed = not jump.where("new < label").isEmpty()
        discard(step)
        labels = jump.select("node", "degree", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
