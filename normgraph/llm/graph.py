"""Connected components of an edge list, by label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stash


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, of each node of edges (a, b); both long.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so the rounds grow with the
    logarithm of a component's length. Each round is written to the shared folder; nothing is collected but a count."""
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stash(both, "edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(
            labels.select(F.col("node").alias("b"), F.col("label").alias("near")),
            "b",
        ).groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        far = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = stash(
            step.join(far, "to").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("old")).alias("moved")),
            "labels",
        )
        moved = new.where("moved").limit(1).count()
        forget(labels)
        labels = new
        if not moved:
            forget(both)
            return labels.select("node", "label")
