"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): label is the smallest node that a path
    reaches. Smallest labels of neighbours and then labels of labels are taken until nothing
    changes; each round is written to the shared folder. Only counts come to the driver.
    A node with very many edges meets them in an aggregate and in joins that Spark can split."""
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = cut(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = cut(step)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = cut(step.join(jump, "label").select("node", "old", F.col("further").alias("label")))
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
