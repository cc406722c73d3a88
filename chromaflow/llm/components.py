"""Connected components of an edge table, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) of each end of ``edges`` (a, b long; loops count as nodes).

    Each round, a component hooks to the smallest component next to it, then paths
    are halved; a component at least pairs up in a round, so rounds grow with the
    logarithm of its size. No task sees a whole component: hubs are summed by
    partial aggregation, and joins on them can be split.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b"), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.lit(1).alias("_")).select("node", F.col("node").alias("comp")), "cc-labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooks = labels.join(near, "node").groupBy("comp").agg(F.least(F.min("near"), F.col("comp")).alias("to"))
        hooks = materialise(hooks, "cc-hooks")
        if hooks.filter("comp <> to").isEmpty():
            break
        for _ in range(2):
            next_ = hooks.select(F.col("comp").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(next_, "to").select("comp", F.col("further").alias("to"))
        labels = materialise(labels.join(hooks, "comp").select("node", F.col("to").alias("comp")), "cc-labels")
    else:
        raise RuntimeError("components did not settle")
    return labels
