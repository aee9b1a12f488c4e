"""Connected components by distributed minimum-label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import unique_join


def components(edges: DataFrame, store: Callable[[DataFrame], DataFrame], a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): each node of an undirected edge with the least node of its component.

    store writes an iteration to shared storage and reads it back, which ends its lineage. Each round
    every node takes the least label among its neighbours and then that label's own label, so rounds
    grow with the logarithm of a component's width. Nothing but a count of changes reaches the driver.
    A node with very many edges and a label with very many nodes are joined by unique_join, never in one task.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = store(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = unique_join(both, labels.select(F.col("node").alias("b"), "label"), ["b"], "inner", store).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = store(unique_join(step, jump, ["label"], "left", store).select("node", "old", F.least("label", "further").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
