"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): label is the smallest node of the component.

    Each round gives a node the least label among its neighbours and then the label of
    its label, so long chains shrink by half.  Neighbours are summed up before they are
    joined, so a hub is no single task's work.  Ends when no label changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = stored(step.join(jump, "to", "left").select("node", F.col("label").alias("was"), F.least("to", F.coalesce("further", "to")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("was <> label").isEmpty():
            return labels
