"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.stage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from every node that has an edge (a, b).

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so long chains shorten by half or more. Neighbours are
    reduced to a minimum before they meet, also those of a node with very many.
    Only the number of changed labels comes to the driver. Null ends are dropped.
    """
    pairs = edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    pairs = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m"))
                 .select("node", F.least("node", "_m").alias("label")))
    while True:
        near = (pairs.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near")))
        # a label may hear of a smaller one through any of the nodes that carry it
        moved = cut(labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_new")))
        # as a table of its own, so that Spark can split a label with very many nodes
        hooked = cut(moved.groupBy(F.col("label").alias("_old")).agg(F.min("_new").alias("_root")))
        step = cut(moved.join(hooked, F.col("label") == F.col("_old"))
                   .select("node", "label", F.least("_new", "_root").alias("_new")))
        jump = step.select(F.col("node").alias("_at"), F.col("_new").alias("_jump"))
        after = cut(step.join(jump, F.col("_new") == F.col("_at"), "left")
                    .select("node", F.col("label").alias("_old"), F.coalesce(F.least("_new", "_jump"), "_new").alias("label")))
        changed = after.filter(F.col("_old") != F.col("label")).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
