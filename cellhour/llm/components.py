"""Connected components of a graph given as edges, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b) can reach.

    Each round takes the least label among neighbours and then that label's own
    label, so long chains shorten quickly; every round's labels are a written table.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(edges.select(F.explode(ways).alias("way")).select("way.a", "way.b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                    .select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
                .groupBy("a").agg(F.min("near").alias("near")))
        reached = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("jump"))
        labels = stored(reached.join(jump, "step", "left")
                        .select("node", "old", F.least("step", "jump").alias("label")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
