"""Formulas against known values and plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import geo, rf, tags
from meridia.functions.numeric import rounded
from meridia.operators.joins import box_join, merged_intervals, overlap_join
from meridia.operators.skyline import skyline
from meridia.plans import ledgers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_knife_edge_golden_values(spark):
    for v, db in ((0.0, 6.032852209), (1.0, 13.925728934), (-2.0, 0.0)):
        assert value(spark, rf.knife_edge_loss(F.lit(v))) == pytest.approx(db, abs=1e-6)


def test_power_round_trip_and_limits(spark):
    assert value(spark, rf.dbm(rf.milliwatts(F.lit(-73.5)))) == pytest.approx(-73.5)
    assert value(spark, rf.dbm(F.lit(0.0))) == float("-inf")
    assert value(spark, rf.free_space_loss(F.lit(0.1), F.lit(1.0))) == pytest.approx(32.45)
    assert [value(spark, rf.wall_loss(F.lit(x))) for x in (2.6, 28.0, 140.0)] == [8.0, 30.0, 80.0]
    assert value(spark, rf.serviceability_failures(F.lit(-110.0), F.lit(-0.1), F.lit(-20.0))) == ["sinr"]
    assert value(spark, rf.entry_loss(F.lit(3.5), F.lit(False))) is None


def test_beam_wraps_and_longitudes(spark):
    assert value(spark, geo.in_beam(F.lit(359.0), F.lit(5.0), F.lit(20.0))) and not value(spark, geo.in_beam(F.lit(20.0), F.lit(350.0), F.lit(20.0)))
    assert value(spark, geo.in_beam(F.lit(180.0), F.lit(0.0), F.lit(360.0)))
    assert value(spark, geo.normal_longitude(F.lit(190.0))) == pytest.approx(-170.0)
    lon, lat = geo.destination(F.lit(32.0), F.lit(39.0), F.lit(90.0), F.lit(1000.0))
    assert value(spark, geo.distance_m(F.lit(32.0), F.lit(39.0), lon, lat)) == pytest.approx(1000, rel=2e-3)


def test_polygons(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))))
    assert value(spark, geo.in_polygon(F.lit(1.0), F.lit(1.0), ring)) and not value(spark, geo.in_polygon(F.lit(2.0), F.lit(3.0), ring))
    assert value(spark, geo.in_or_on_polygon(F.lit(4.0), F.lit(2.0), ring))
    assert value(spark, geo.crossings(F.lit(-1.0), F.lit(3.0), F.lit(5.0), F.lit(3.0), ring)) == pytest.approx([1 / 6, (2 / 3 + 1) / 6, (2 + 4 / 3 + 1) / 6, 5 / 6])
    square = F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    assert tuple(value(spark, geo.centroid(square))) == pytest.approx((1, 1))
    assert len(value(spark, geo.perimeter_points(square))) == 9
    flat = F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(0.0).alias("lat")) for x in (0, 1, 5)))
    assert tuple(value(spark, geo.centroid(flat))) == pytest.approx((2, 0))


def test_quadkeys(spark):
    assert tuple(value(spark, geo.quadkey_tile(F.lit("213")))) == (3, 5, 3)
    west, south, east, north = (value(spark, c) for c in geo.tile_bounds(F.lit(3), F.lit(5), F.lit(3)))
    assert (west, east) == (-45.0, 0.0) and south < north < 0


@pytest.mark.parametrize("text,metres", [("12", 12.0), ("12 m", 12.0), ("40 ft", 12.192), ("30'", 9.144), ("0.5", None), ("x", None), ("", None), ("501", None), ("7 metres", 7.0)])
def test_lengths(spark, text, metres):
    got = value(spark, tags.length_m(F.lit(text)))
    assert got is None if metres is None else got == pytest.approx(metres)


def test_height_falls_back_in_order(spark):
    h = lambda a, b: tuple(value(spark, tags.height(F.lit(a).cast("string"), F.lit(b).cast("string"))))
    assert h("12", "3") == (12.0, "observed_tag") and h(None, "3") == (9.0, "derived_from_levels") and h("bad", None) == (9.0, "unavailable") and h(None, "900") == (500.0, "derived_from_levels")
    assert value(spark, tags.material(F.lit("plaster"), F.lit("Steel and glass"))) == "glass"


def test_rounding_is_half_away_from_zero(spark):
    assert [value(spark, rounded(F.lit(x), 1)) for x in (0.25, -0.25, 1.04)] == [0.3, -0.3, 1.0]


def test_joins_find_every_pair_once(spark):
    rng = random.Random(1)
    p = [(i, rng.uniform(0, 0.1), rng.uniform(0, 0.1)) for i in range(300)]
    b = [(i, x, y, x + rng.uniform(0, 0.02), y + rng.uniform(0, 0.02)) for i, x, y in ((j, rng.uniform(-0.01, 0.1), rng.uniform(-0.01, 0.1)) for j in range(60))]
    points, boxes = spark.createDataFrame(p, "p int, lon double, lat double"), spark.createDataFrame(b, "b int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.p, r.b) for r in box_join(points, "lon", "lat", boxes, tuple(map(F.col, ("x0", "y0", "x1", "y1")))).collect()]
    assert sorted(got) == sorted((i, j) for i, x, y in p for j, x0, y0, x1, y1 in b if x0 <= x <= x1 and y0 <= y <= y1)
    other = boxes.toDF("c", "u0", "v0", "u1", "v1")
    got = [(r.b, r.c) for r in overlap_join(boxes, tuple(map(F.col, ("x0", "y0", "x1", "y1"))), other, tuple(map(F.col, ("u0", "v0", "u1", "v1")))).collect()]
    assert sorted(got) == sorted((i[0], j[0]) for i in b for j in b if i[1] <= j[3] and j[1] <= i[3] and i[2] <= j[4] and j[2] <= i[4])


def test_intervals_and_skyline(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.5, 0.7), ("a", 1.0, 2.0), ("a", 3.0, 4.0), ("b", 0.0, 1.0)], "k string, s double, e double")
    assert sorted(map(tuple, merged_intervals(df, ["k"], "s", "e").collect())) == [("a", 0.0, 2.0), ("a", 3.0, 4.0), ("b", 0.0, 1.0)]
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (200, 3))
    rows = [(i, *map(int, r)) for i, r in enumerate(x)]
    got = {r.i for r in skyline(spark.createDataFrame(rows, "i int, a int, b int, c int").repartition(4), {"a": "max", "b": "min", "c": "max"}).collect()}
    y = x * [1, -1, 1]
    assert got == {i for i in range(200) if not ((y >= y[i]).all(1) & (y > y[i]).any(1)).any()}
    some = spark.createDataFrame([(1, 5, None), (2, 4, 9), (3, 3, 8)], "i int, a int, b int")
    assert {r.i for r in skyline(some, {"a": "max", "b": "max"}).collect()} == {1}


def test_slab_keeps_power(spark):
    rows = [(28.0, 5.24, loss, 0.1, 30.0) for loss in (0.0, 0.4)]
    a, b = sorted((r.reflected + r.transmitted, r.transmitted) for r in ledgers.slab(spark.createDataFrame(rows, "ghz double, real double, loss double, metres double, degrees double")).collect())[::-1]
    assert a[0] == pytest.approx(1.0) and b[0] < 1 and b[1] < 0.1
    # against complex arithmetic
    eps, s = 5.24 - 0.4j, np.sin(np.radians(30.0))
    n, inner = np.sqrt(eps), np.sqrt(1 - s * s / eps)
    r = (np.sqrt(1 - s * s) - n * inner) / (np.sqrt(1 - s * s) + n * inner)
    phase = 2 * np.pi * 28.0 / 0.299792458 * 0.1 * n * inner
    assert b[1] == pytest.approx(abs((1 - r * r) * np.exp(-1j * phase) / (1 - r * r * np.exp(-2j * phase))) ** 2)
