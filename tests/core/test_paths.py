"""Paths against boxes a grid cell at a time: the same crossings as row by row, and no rows of pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators.paths import Places, box_crossings, near_pairs
from meridia.plans import catalogue

SF = "/root/testdata/sf0.001"


def drawn():
    dice = random.Random(5)
    p = lambda: dice.uniform(-0.005, 0.005)
    ends = [(p(), p()) for _ in range(80)] + [(0.003, 0.0), (0.0, -0.004), (-0.005, 0.0), (-0.005, 1e-12), (0.002, 0.002), (0.0001, 0.0)]
    boxes = [(p(), p(), dice.uniform(0, 0.0006)) for _ in range(120)] + [(0.0, 0.0, 0.0003), (0.002, 0.0, 0.0005), (-0.001, -0.0005, 0.0005), (0.0003, 0.0, 0.0003), (-0.003, 0.0, 0.0001)]
    return ends, boxes


def test_paths_cross_boxes_as_rings(spark):
    ends, boxes = drawn()
    corner = lambda x, y: F.struct((F.col("lon") + x * F.col("half")).alias("lon"), (F.col("lat") + y * F.col("half")).alias("lat"))
    s = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "s int, qx double, qy double").crossJoin(spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "b int, lon double, lat double, half double"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    want = {(r.s, r.b): r.t for r in s.select("s", "b", geo.crossings(F.lit(0.0), F.lit(0.0), F.col("qx"), F.col("qy"), ring).alias("t")).where("size(t) > 0").collect()}
    (qx, qy), (lon, lat, half) = np.array(ends).T, np.array(boxes).T
    path, b = near_pairs(0.0, 0.0, qx, qy, {"lon": lon, "lat": lat, "half": half})
    t = box_crossings(0.0, 0.0, qx[path], qy[path], lon[b], lat[b], half[b])
    got = [((p, k), [x for x in row if x == x]) for p, k, row in zip(path.tolist(), b.tolist(), t.tolist())]
    assert len(got) == len({k for k, _ in got})  # a pair comes once
    assert {k: v for k, v in got if v} == want


def test_places_are_held_by_the_first_box():
    dice = np.random.default_rng(3)
    lon, lat, half = dice.uniform(0, 0.004, 60), dice.uniform(0, 0.004, 60), dice.uniform(0, 0.0005, 60)
    px, py = np.append(dice.uniform(-0.001, 0.005, 4000), [lon[0] - half[0], lon[0] + half[0]]), np.append(dice.uniform(-0.001, 0.005, 4000), [lat[0], lat[0]])
    inside = (px[:, None] >= lon - half) & (px[:, None] < lon + half) & (py[:, None] >= lat - half) & (py[:, None] < lat + half)
    assert (Places(lon, lat, half).first(px, py) == np.where(inside.any(1), inside.argmax(1), -1)).all()
    assert (Places(*np.zeros((3, 0))).first(px, py) == -1).all()


@pytest.mark.parametrize("name", ["coverage_surface", "diffraction_edges", "path_profile"])
def test_paths_are_no_rows(name, spark):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan  # before, paths were joined with footprints and shuffled
