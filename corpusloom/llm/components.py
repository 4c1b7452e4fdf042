"""Connected components of links between classes, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import saved


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, comp): the least node that each node reaches. Nodes without links have no row.

    A round takes the least label among a node's neighbours, then the label of its label, so that the rounds grow with the logarithm of
    a path's length; each is a table in the shared folder."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("before"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = saved(step.join(jump, "mid").select("node", "before", F.least("mid", "far").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where("before != comp").isEmpty():
            return labels
