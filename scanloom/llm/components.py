"""Connected components of a graph that is a table of edges (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b), of any type that has an order -> (node, root): each node of an edge and the least of its component.

    Each round every node hooks onto its least neighbour, chains of hooks are halved until they end, and the edges
    between what is left go on; the nodes at least halve. Counts of rows alone reach the driver. Loops, repeated edges and
    either direction are the same; edges with a null are none; without edges there are no rows.
    """
    e = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e, labels = stage(e, f"{name}-edges"), None
    while labels is None or not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")), f"{name}-hooks")
        while True:
            top = hooks.select(F.col("node").alias("up"), F.col("up").alias("over"))
            jumped = stage(hooks.join(top, "up").select("node", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")), f"{name}-jump")
            unstage(hooks)
            hooks = jumped
            if hooks.filter("moved").isEmpty():
                break
        if labels is None:
            labels = stage(hooks.select("node", F.col("up").alias("root")), f"{name}-labels")
        else:
            next_ = hooks.select(F.col("node").alias("root"), "up")
            old, labels = labels, stage(labels.join(next_, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-labels")
            unstage(old)
        of_a = hooks.select(F.col("node").alias("a"), F.col("up").alias("x"))
        of_b = hooks.select(F.col("node").alias("b"), F.col("up").alias("y"))
        rest = e.join(of_a, "a").join(of_b, "b").filter("x <> y")
        old, e = e, stage(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
        unstage(old, hooks)
    unstage(e)
    return labels
