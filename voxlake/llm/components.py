"""Connected components by repeated joins; nothing of the graph comes to the driver but a count each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """id and component (least id reachable) of each end of ``edges`` (a, b); others are their own component.

    Each round a vertex takes the least label around it, then the label of its label, so paths halve.  Labels of a
    vertex's neighbours are reduced before the shuffle, so one with a third of all edges is a few rows.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), spark)
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")), spark)
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = labels.select("a", "c").join(near, "a").select("a", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        over = labels.select(F.col("a").alias("c"), F.col("c").alias("cc"))
        nxt = written(step.join(over, "c", "left").select("a", "old", F.least(F.col("c"), F.coalesce("cc", "c")).alias("c")), spark)
        dropped(labels)
        labels = nxt
        if nxt.where("old <> c").isEmpty():
            dropped(both)
            return labels.select(F.col("a").alias("id"), F.col("c").alias("component"))
