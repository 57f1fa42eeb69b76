"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import cut, remove


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round takes the smallest label of the neighbours, then the label of the label, so paths halve.
    Labels are written after each round; a node with very many edges only ever meets as partial minima.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.filter("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    before = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        best = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(best, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        top = labels.select(F.col("node").alias("now"), F.col("component").alias("far"))
        step = cut(step.join(top, "now").select("node", "was", F.least("now", "far").alias("component")), "labels")
        labels = step.select("node", "component")
        remove(before)  # the round before is written over by this one
        before = step
        if step.filter("was <> component").isEmpty():
            return labels
