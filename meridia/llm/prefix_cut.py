"""Per group, the rows of smallest key whose sizes fill a target: a distributed running sum without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._common import checked_broadcast, stage_table

#: Histogram cells of one level. Two levels leave about a 16-millionth of a group for the exact, row-wise step.
CELLS = 4096


def _crossing(sums: DataFrame, cell: str, group: str) -> DataFrame:
    """Of each group the cell in which the running sum passes ``room``, with what the cells before it hold."""
    run = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn("upto", F.sum("held").over(run)).where((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("held") <= F.col("room"))).select(group, F.col(cell), (F.col("room") - F.col("upto") + F.col("held")).alias("room"))


def prefix_cut(rows: DataFrame, rooms: DataFrame, group: str = "g", key: str = "key", size: str = "size", ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows (group, key in [0, 1), size >= 0, ties) and rooms (group, room) -> (group, cut_at, room_left).

    cut_at is the ``position`` of the first row, in order of key and ties, with which the running sum of sizes exceeds
    the room; a group without one fits whole and has no row here. room_left is what the rows before it leave. Rows with
    equal key and ties are one place: they are before the cut together or not at all. Sums go by (group, cell) with
    map-side combine; only the places of one second-level cell of each group, about a 16-millionth of it, are ever
    ordered together.
    """
    rows = rows.withColumn("c1", F.floor(F.col(key) * CELLS).cast("int")).withColumn("c2", F.floor((F.col(key) * CELLS - F.floor(F.col(key) * CELLS)) * CELLS).cast("int"))
    rooms = checked_broadcast(rooms)
    one = rows.groupBy(group, "c1").agg(F.sum(size).alias("held")).join(rooms, group)
    one = stage_table(_crossing(one, "c1", group), "cut1")
    inside = rows.join(checked_broadcast(one), [group, "c1"])
    two = stage_table(_crossing(inside.groupBy(group, "c1", "c2", "room").agg(F.sum(size).alias("held")), "c2", group).join(one.select(group, "c1"), group), "cut2")
    last = rows.join(checked_broadcast(two), [group, "c1", "c2"]).groupBy(group, "room", key, *ties).agg(F.sum(size).alias("_held"))
    run = Window.partitionBy(group).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = last.withColumn("upto", F.sum("_held").over(run)).where((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("_held") <= F.col("room")))
    at = F.struct(F.col(key).alias("k"), *(F.col(t).alias(t) for t in ties))
    cuts = first.groupBy(group).agg(F.min(F.struct(at.alias("at"), (F.col("room") - F.col("upto") + F.col("_held")).alias("left"))).alias("m"))
    return stage_table(cuts.select(group, F.col("m.at").alias("cut_at"), F.col("m.left").alias("room_left")), "cuts")


def position(key: str = "key", ties: tuple[str, ...] = ("doc_id",)):
    """A row's place, to compare with ``cut_at``."""
    return F.struct(F.col(key).alias("k"), *(F.col(t).alias(t) for t in ties))
