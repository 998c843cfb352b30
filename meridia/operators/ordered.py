"""Ranks, running sums and followers over a whole table in a total order, without a task that holds the table.

A window with an order and no key would send every row to one task. Here rows are dealt to ranges of the order; only one row per
range (as many as there are shuffle partitions) meets in one task. Ranges are drawn from a sample, so they are written down once:
a task that is run again after a lost executor must not see other ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.tables import shared_table


def _dealt(df: DataFrame, order: list) -> DataFrame:
    return shared_table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")


def running(df: DataFrame, order: list, to: str, value: Column | None = None) -> DataFrame:
    """df with the sum of ``value`` (1: the rank) up to and with each row; ``order`` must be total."""
    r = _dealt(df.withColumn("_v", F.lit(1).cast("long") if value is None else value), order)
    ranges = r.groupBy("_range").agg(F.sum("_v").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("_v").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = r.join(F.broadcast(ranges.select("_range", before.alias("_before"))), "_range")  # one row a range
    return out.withColumn(to, F.col("_before") + own).drop("_v", "_range", "_before")


def followed(df: DataFrame, order: list[str], columns: list[str], to: str = "next") -> DataFrame:
    """df with a struct of the next row's ``columns`` in ascending ``order`` (total); null at the last row."""
    r = _dealt(df, order)
    row = F.struct(*columns)
    first = r.groupBy("_range").agg(F.min_by(row, F.struct(*order)).alias("_first"))
    ahead = first.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_ahead"))
    inside = F.lead(row).over(Window.partitionBy("_range").orderBy(*order))
    return r.join(F.broadcast(ahead), "_range").withColumn(to, F.coalesce(inside, "_ahead")).drop("_range", "_ahead")  # one row a range
