"""Contour lines of a lattice of values: crossings by interpolation, segments by square, lines by chains of segments.

A lattice edge is named by its lower corner and whether it goes up; a contour crosses it at one place. In a square whose
corners are walked around against the clock, a segment leads from a crossing into lower values to one into higher values,
so higher values lie on its left and the segments of neighbouring squares follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators.chains import chains

#: The corners of a square, walked around: rows and columns beyond its own.
CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))


def squares(lattice: DataFrame) -> DataFrame:
    """(r, c, v) -> (r, c, v0..v3) of the squares whose four corners are known. A value goes to the four squares it is a corner of: one
    aggregation instead of joins of the lattice with itself."""
    corner = F.array(*(F.struct(F.lit(i).alias("i"), (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c")) for i, (dr, dc) in enumerate(CORNERS)))
    e = lattice.where("v IS NOT NULL").withColumn("k", F.explode(corner)).select("k.r", "k.c", "k.i", "v")
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"v{i}")
    return e.groupBy("r", "c").agg(*map(at, range(4)), F.count("*").alias("n")).where("n = 4").drop("n")


def _edge(i: int) -> Column:
    """The edge after corner i of a square: (r, c, up)."""
    dr, dc, up = ((0, 0, False), (0, 1, True), (1, 0, False), (0, 0, True))[i]
    return F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.lit(up).alias("up"))


def _crossing(i: int) -> Column:
    """Where the contour crosses edge i, from the edge's lower corner on, in lattice steps (row, col)."""
    a, b = (i, (i + 1) % 4) if i < 2 else ((i + 1) % 4, i)
    share = (F.col("level") - F.col(f"v{a}")) / (F.col(f"v{b}") - F.col(f"v{a}"))
    (ra, ca), (rb, cb) = CORNERS[a], CORNERS[b]
    return F.struct((F.col("r") + ra + share * (rb - ra)).alias("row"), (F.col("c") + ca + share * (cb - ca)).alias("col"))


def segments(lattice: DataFrame, levels: list[float]) -> DataFrame:
    """(level, a, b, at_a, at_b): directed segments between crossings. A saddle is settled by the mean of its corners."""
    q = squares(lattice).withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels))))
    high = [F.col(f"v{i}") >= F.col("level") for i in range(4)]
    q = q.where(~((high[0] == high[1]) & (high[1] == high[2]) & (high[2] == high[3])))
    down = [high[i] & ~high[(i + 1) % 4] for i in range(4)]
    up = [~high[i] & high[(i + 1) % 4] for i in range(4)]
    saddle = (high[0] == high[2]) & (high[1] == high[3])
    middle = (F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")) / 4 >= F.col("level")
    link = lambda i, j: F.struct(_edge(i).alias("a"), _edge(j).alias("b"), _crossing(i).alias("at_a"), _crossing(j).alias("at_b"))
    both = lambda i, j: F.when(down[i], link(i, j)).otherwise(link(j, i))
    first = lambda flags, pick: F.coalesce(*(F.when(flags[i], pick(i)) for i in range(4)))
    plain = first(down, lambda i: first(up, lambda j: link(i, j)))
    found = F.when(saddle & middle, F.array(both(0, 3), both(1, 2))).when(saddle, F.array(both(0, 1), both(2, 3))).otherwise(F.array(plain))
    return q.select("level", F.explode(found).alias("s")).select("level", "s.*")


def contour_lines(lattice: DataFrame, levels: list[float]) -> DataFrame:
    """(r, c, v) -> (level, line, closed, place, row, col): the crossings of each line in order. ``line`` names the lattice edge it begins
    at, as ``r:c:up``; null values are no corners."""
    s = segments(lattice, levels)
    points = s.select("level", F.explode(F.array(F.struct(F.col("a").alias("e"), "at_a"), F.struct(F.col("b").alias("e"), F.col("at_b").alias("at_a")))).alias("p"))
    points = points.groupBy("level", F.col("p.e").alias("edge")).agg(F.min("p.at_a").alias("at"))
    named = lambda name: F.struct(F.col("level").alias("level"), F.col(f"{name}.r").alias("r"), F.col(f"{name}.c").alias("c"), F.col(f"{name}.up").alias("up"))
    order = chains(s.select(named("a").alias("a"), named("b").alias("b")))
    placed = order.select(F.col("element.level").alias("level"), F.struct(F.col("element.r").alias("r"), F.col("element.c").alias("c"), F.col("element.up").alias("up")).alias("edge"), "chain", "place", "closed")
    name = F.concat_ws(":", F.col("chain.r").cast("string"), F.col("chain.c").cast("string"), F.col("chain.up").cast("int").cast("string"))
    return placed.join(points, ["level", "edge"]).select("level", name.alias("line"), "closed", "place", F.col("at.row").alias("row"), F.col("at.col").alias("col"))
