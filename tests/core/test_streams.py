"""Kernels whose results are as many as pairs: they leave the task a few at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import geo, tags
from meridia.functions import reflection as rx
from meridia.operators.paths import BLOCK
from meridia.plans import catalogue, lens, radio, reflection, studies
from meridia.plans.buildings import _tall

SF = "/root/testdata/sf0.01"


def columns(df):
    return {c: v.to_numpy() for c, v in df.toPandas().items()}


@pytest.fixture(scope="module")
def sides(spark):
    """All samples, footprints and cells as one call of a kernel would get them."""
    scale = F.cos(F.radians("lat"))
    c = lens.cells(spark, SF).select("cell_id", "lon", "lat", "radius_m", "azimuth", "ghz", (scale * rx.DEGREE_M).alias("k"), scale.alias("scale")).orderBy("cell_id")
    dx = geo.bounds_around(F.lit(0.0), F.col("lat"), F.lit(reflection.NEAR_M))[2]
    b = _tall(spark, SF).select("building_id", "lon", "lat", "half", tags.material(F.col("material_tag")).alias("material"), F.when(F.col("evidence") != "unavailable", F.col("height_m")).alias("top"), F.col("height_m"), dx.alias("dx"), F.lit(reflection.NEAR_M / geo.DEGREE_M).alias("dy"))
    return columns(lens.samples(spark, SF).select("sample_id", "lon", "lat")), columns(b), columns(c)


def together(parts):
    names = [n for n in parts[0] if n != "material"]
    return sorted(zip(*(np.concatenate([p[n] for p in parts]).tolist() for n in names)), key=lambda r: r[:4])


def test_reflected_paths_leave_a_few_at_a_time(sides, monkeypatch):
    every = list(reflection._paths(*sides))
    monkeypatch.setattr(reflection, "MOST_PATHS", 20)
    monkeypatch.setattr(reflection, "MOST_PAIRS", 50)
    parts = list(reflection._paths(*sides))
    assert len(parts) > 3 and max(len(p["edge"]) for p in parts) < 20 + 50
    assert str(together(parts)) == str(together(every))


def test_profiles_leave_a_few_at_a_time(sides):
    parts = list(studies._profiles(*sides))
    assert sum(len(p["n"]) for p in parts) > BLOCK >= max(len(p["n"]) for p in parts)


@pytest.mark.parametrize("name", ["path_profile", "specular_ledger", "serving_cell_rank"])
def test_results_are_streamed(name, spark):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Sort [sample_id" not in plan  # pairs are neither sorted nor held by a group


def test_ranks_of_a_crowd():
    """More samples at one place than are ranked together; cells of equal power are ranked by id."""
    n = 3 * radio.RANKED + 1
    points = {"sample_id": np.arange(n), "lon": np.full(n, 32.9), "lat": np.full(n, 40.0)}
    cells = {"cell_id": np.array([3, 5, 9]), "lon": np.array([32.9, 32.9, 33.5]), "lat": np.full(3, 39.999), "radius_m": np.full(3, 500.0), "azimuth": np.zeros(3), "ghz_db": np.full(3, 8.0), "rb_db": np.full(3, 30.0), "scale": np.full(3, np.cos(np.radians(39.999)))}
    parts = list(radio._signals_of(points, cells))
    rows = sorted(zip(*(np.concatenate([p[c] for p in parts]).tolist() for c in ("sample_id", "cell_id", "rank"))))
    assert rows == [(i, c, r) for i in range(n) for c, r in ((3, 1), (5, 2))] and len(parts) == 4


def test_rows_of_one_sample_are_ranked_together():
    n = 2 * radio.RANKED + 1
    points = {"sample_id": np.repeat(np.arange(n), 3), "lon": np.full(3 * n, 32.9), "lat": np.full(3 * n, 40.0)}
    cells = {"cell_id": np.array([3]), "lon": np.array([32.9]), "lat": np.array([39.999]), "radius_m": np.array([500.0]), "azimuth": np.zeros(1), "ghz_db": np.array([8.0]), "rb_db": np.array([30.0]), "scale": np.cos(np.radians([39.999]))}
    rows = [(i, r) for p in radio._signals_of(points, cells) for i, r in zip(p["sample_id"].tolist(), p["rank"].tolist())]
    assert sorted(rows) == [(i, r) for i in range(n) for r in (1, 2, 3)]
