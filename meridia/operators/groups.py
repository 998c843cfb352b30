"""Groups of linked nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.tables import shared_table


def linked_groups(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that links lead to. Labels spread to neighbours and are then halved in
    distance by asking each label for its own label; lineage is cut every round."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = shared_table(both, "links")
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node")
    label = shared_table(label, "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near"))
        step = label.join(near, "node").select("node", F.least("c", "near").alias("c"))
        root = step.select(F.col("node").alias("c"), F.col("c").alias("up"))
        fresh = shared_table(step.join(root, "c", "left").select("node", F.least("c", F.coalesce("up", "c")).alias("c")), "labels")
        if fresh.join(label.withColumnRenamed("c", "old"), "node").where("c <> old").isEmpty():
            return fresh.select("node", F.col("c").alias("component"))
        label = fresh
