"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs; gives (v, c) for every end: c is the smallest v that can be reached.

    Each round takes the smallest label among neighbours and jumps to that label's own label, so chains
    shorten by half and stars end after two rounds. Labels stay distributed; each round is a written table, and
    tables of earlier rounds are deleted. Repeated links count once; no links give no rows.
    """
    both = shared.written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = shared.written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "v"))
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("c").alias("m"))
        step = shared.written(labels.join(near, labels.v == near.a, "left").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        up = step.select(F.col("v").alias("c"), F.col("c").alias("top"))
        new = shared.written(step.join(up, "c", "left").select("v", F.least(F.col("c"), F.coalesce("top", "c")).alias("c"), (F.coalesce("top", "c") < F.col("old")).alias("moved")))
        done = new.where("moved").isEmpty()
        shared.deleted(labels, step)
        labels = new
        if done:
            shared.deleted(both)
            return labels.select("v", "c")
