"""Connected components by alternating large-star and small-star contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._common import drop_tables, stage_table


def _star(directed: DataFrame, keep) -> DataFrame:
    """Each node's neighbours that ``keep`` lets through are tied to the node's smallest neighbour (itself included).

    The minimum is map-side combined; the join back is a plain equi-join, so AQE splits a hub's rows.
    """
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    tied = directed.join(least, directed.u == least.n).where(keep)
    return tied.select(F.col("v").alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable. Only nodes with an edge to another node are returned."""
    pairs = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct()
    pairs = stage_table(pairs, "edges")
    seen = None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        pairs, old = stage_table(small.where("a <> b").distinct(), "stars"), pairs
        drop_tables(old)
        digest = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (digest.n, digest.h) == seen:
            break
        seen = (digest.n, digest.h)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
