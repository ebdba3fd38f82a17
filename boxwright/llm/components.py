"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); nodes of one component share a root.

    Each round every node hooks onto its smallest neighbour, looks one hook further,
    and the edges are contracted to the hooks; all of it are joins and partial
    aggregates, and each round's tables are written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    live, labels = written(both, "edges"), None
    while True:
        hook = written(live.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "hook")
        further = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jump = written(hook.join(further, "p").select("a", F.col("pp").alias("p")), "jump")
        if labels is None:
            labels = written(jump.select(F.col("a").alias("node"), F.col("p").alias("root")), "labels")
        else:
            to = jump.select(F.col("a").alias("root"), F.col("p").alias("next"))
            old, labels = labels, written(labels.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
            drop_written(old)
        left = jump.select("a", F.col("p").alias("pa"))
        right = jump.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        hooks = labels.select(F.col("root").alias("a")).distinct().join(jump, "a").select("a", F.col("p").alias("b"))
        moved = moved.unionByName(hooks).unionByName(hooks.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        old, live = live, written(moved, "edges")
        drop_written(old, hook, jump)
        if live.isEmpty():
            drop_written(live)
            return labels
