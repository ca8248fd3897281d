"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of edges (a, b), the smallest node that it reaches.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so long paths halve.
    A hub's edges aggregate before the shuffle; nothing but a sum comes to the driver. Lineage is cut each round.
    """
    both = edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    both = stored(both.dropDuplicates(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    total = None
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        low = labels.join(heard, "node", "left").select("node", F.least("root", F.coalesce("heard", "root")).alias("root"))
        jumped = low.join(labels.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
        labels = stored(jumped.select("node", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)")), F.count("*")).first()
        if now == total:
            return labels
        total = now
