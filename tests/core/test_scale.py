"""Steps that many queries share: each pair once, and no more rows than the work needs."""

import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators.joins import box_join, segment_join
from meridia.plans import catalogue, network

SF = "/root/testdata/sf0.001"


def test_segments_meet_boxes_once(spark):
    dice = random.Random(3)
    p = lambda: dice.uniform(0, 0.02)
    segments = [(i, p(), p(), p(), p()) for i in range(60)] + [(60, 0.003, 0.0, 0.003, 0.02), (61, 0.02, 0.003, 0.0, 0.003), (62, 0.005, 0.005, 0.005, 0.005)]
    boxes = [(i, x, y, x + dice.uniform(0, 0.003), y + dice.uniform(0, 0.003)) for i, x, y in ((i, p(), p()) for i in range(80))] + [(80, 0.003, 0.003, 0.005, 0.005)]

    def meets(s, b):
        low, high = 0.0, 1.0
        for a, q, lo, hi in ((s[1], s[3], b[1], b[3]), (s[2], s[4], b[2], b[4])):
            if a == q:
                if not lo <= a <= hi:
                    return False
                continue
            t = sorted(((lo - a) / (q - a), (hi - a) / (q - a)))
            low, high = max(low, t[0]), min(high, t[1])
        return low <= high

    s, b = spark.createDataFrame(segments, "s int, ax double, ay double, bx double, by double"), spark.createDataFrame(boxes, "b int, x0 double, y0 double, x1 double, y1 double")
    got = segment_join(s, tuple(map(F.col, ("ax", "ay", "bx", "by"))), b, tuple(map(F.col, ("x0", "y0", "x1", "y1"))))
    assert sorted((r.s, r.b) for r in got.select("s", "b").collect()) == sorted((x[0], y[0]) for x in segments for y in boxes if meets(x, y))


def test_rings_of_four_cross_as_others(spark):
    ring = "array(named_struct('lon', 0D, 'lat', 0D), named_struct('lon', 2D, 'lat', 0D), named_struct('lon', 2D, 'lat', 2D), named_struct('lon', 0D, 'lat', 2D))"
    five = ring.replace("named_struct('lon', 2D, 'lat', 0D)", "named_struct('lon', 1D, 'lat', 0D), named_struct('lon', 2D, 'lat', 0D)")
    lines = spark.createDataFrame([(-1.0, 1.0, 3.0, 1.0), (-1.0, -1.0, 3.0, 3.0), (1.5, 1.0, 1.5, 5.0), (5.0, 5.0, 6.0, 6.0)], "ax double, ay double, bx double, by double")
    at = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    for r in lines.select(geo.crossings(*at, F.expr(ring)).alias("a"), geo.crossings(*at, F.expr(five)).alias("b")).collect():
        assert r.a == r.b


def test_pairs_of_a_small_file_are_made_by_many_tasks(spark):
    points = spark.range(2000).select((F.col("id") % 50 * 0.01).alias("x"), (F.floor(F.col("id") / 50) * 0.01).alias("y")).coalesce(1)
    boxes = spark.range(1).select(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    pairs = box_join(points, "x", "y", boxes, tuple(map(F.col, ("x0", "y0", "x1", "y1"))), 0.05)
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_masks_hold_the_azimuths_in_one_row_a_pair(spark):
    m = network.masks(spark, SF)
    assert m.count() == m.select("cell_id", "building_id").distinct().count()
    near = network.reached(spark, SF)
    swept = near.withColumn("azimuth", F.explode(F.sequence(F.lit(0), F.lit(350), F.lit(10)))).where(geo.in_beam(F.col("bearing"), F.col("azimuth"), F.lit(120.0)))
    keys = lambda df: sorted(map(tuple, df.select("cell_id", "building_id", "azimuth").collect()))
    assert keys(network.contributions(spark, SF)) == keys(swept)


@pytest.mark.parametrize("name", ["mended_footprints"])
def test_slow_rows_of_a_small_file_are_dealt(name, spark):
    q = catalogue.QUERIES[name](spark, SF)
    assert q.rdd.getNumPartitions() > 1  # one split, so one task, before
