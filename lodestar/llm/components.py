"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node it is connected to, for every node of edges (a, b).

    Each round takes the smallest label among a node's neighbours, then the label of that label,
    so a chain of n nodes takes about log2(n) rounds.  Each round's table is written, so
    a lost executor never goes back further than one round.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        low = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("via"))
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = materialize(low.join(far, "via").select("node", "was", F.least("via", "far").alias("label")), "labels")
        release(labels)
        if not after.filter("label != was").head(1):
            release(both)
            return after.select("node", "label")
        labels = after
