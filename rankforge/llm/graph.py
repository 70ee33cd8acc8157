"""Connected components of a link table, wholly on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, cls) for every node of ``links`` (a, b); cls is the smallest
    node of its component.

    Each round takes the smallest label among a node's neighbours and then
    jumps to the label's own label, so rounds grow with the logarithm of the
    longest path; all reductions combine before the shuffle.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("cls")), "labels")
    while True:
        near = (edges.join(labels, edges.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("cls").alias("near")))
        lower = labels.join(near, "node").select("node", "cls", F.least("cls", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("cls").alias("lowest"))
        moved = stored(lower.join(jump, "low").select("node", "cls", F.least("low", "lowest").alias("new")), "labels")
        if moved.filter("cls <> new").isEmpty():
            return labels
        labels = moved.select("node", F.col("new").alias("cls"))
