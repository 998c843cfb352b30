"""What plans reach, summed a grid cell at a time, against rows of pairs; a plan's search against the plan's cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import plans as sums
from meridia.plans import lens, objectives, radio, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cells(spark):
    """Two plans whose cells reach the same places; the second has one cell, not at its first place."""
    c = lens.cells(spark, SF).where("cell_id < 10 AND cell_id <> 8")
    return c.withColumn("radius_m", F.lit(6000.0)).withColumn("channel", F.when(F.col("cell_id") % 3 == 0, "A").otherwise("B")).cache()


def test_masks_at_the_edges_of_beams():
    bearing = np.array([0.0, 10.0, 90.0, 355.0, 3.3, 59.9999999999, 60.0, 120.00000000001, 359.9999999999999])
    for b, m in zip(bearing, sums.azimuth_masks(bearing, 120.0)):
        assert {t for t in range(36) if m >> t & 1} == {t for t in range(36) if abs((b - t * 10 + 540.0) % 360.0 - 180.0) <= 60}


def rows(df, *values):
    out = {}
    for r in df.collect():
        key = (r.plan, tuple(r.masks), *([tuple(r.outs)] if "outs" in df.columns else []))
        out[key] = [a + b for a, b in zip(out.get(key, [0] * len(values)), (r[v] for v in values))]
    return {k: [pytest.approx(x) for x in v] for k, v in out.items()}


def test_buildings_are_summed_where_they_lie(spark, cells):
    b = lens.buildings(spark, SF).withColumnRenamed("residential", "homes")
    at = cells.select("cell_id", "radius_m", F.col("lon").alias("x"), F.col("lat").alias("y"))
    near = b.crossJoin(at).where(geo.distance_m(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")) <= F.col("radius_m")).withColumn("bearing", geo.bearing_deg(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")))
    contrib = near.withColumn("azimuth", F.explode(F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: i * 10))).where(geo.in_beam(F.col("bearing"), F.col("azimuth"), F.lit(radio.BEAM_DEG)))
    want = objectives.worth(contrib.select("cell_id", "azimuth", "building_id", "demand"), search.plans_of(cells), b.select("building_id", "homes"))
    got = sums.reached_sums(b, cells, ["demand", "homes"], radio.BEAM_DEG)
    assert rows(got, "demand", "homes", "n") == rows(want, "demand", "homes", "n")
    assert any(sum(m > 0 for m in k[1]) > 2 for k in rows(got, "n"))  # cells of a plan do overlap


def test_samples_are_summed_where_they_lie(spark, cells):
    samples = lens.samples(spark, SF)
    want = objectives.outcomes(objectives.domain(samples, cells, search.plans_of(cells)))
    got = objectives.heard_sums(samples, cells, True)
    assert rows(got, "n") == rows(want, "n")
    ok = want.withColumn("outs", F.transform("outs", lambda o: F.when(o == objectives.NONE, o).otherwise(o.bitwiseAND(F.lit(1)))))
    assert rows(objectives.heard_sums(samples, cells, False), "n") == rows(ok, "n")


def test_every_plan_has_an_archive(spark, cells):
    plans = search.plans_of(cells)
    found = sums.reached_sums(lens.buildings(spark, SF), cells, ["demand"], radio.BEAM_DEG)
    got = search.archive_search(found, search.start_states(plans, (0,)), 2).collect()
    assert {r.plan for r in got} == {0, 1} and all((t < 0) == (r.plan == 1 and i != 1) for r in got for i, t in enumerate(r.turns))


def test_a_search_has_no_job_for_each_step(spark):
    """Start states and sums are the only shuffles: steps write no tables and pairs are no rows."""
    for name in ("network_search", "network_multistart", "network_archive"):
        plan = getattr(search, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapCoGroups") == 2 and "Join" not in plan


def test_the_weighted_search_has_all_of_its_passes(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(objectives, "multistart", lambda *a, **k: asked.update(k, most_passes=(a[5:] or [k.get("most_passes", objectives.MOST_PASSES)])[0]))
    objectives.objective_multistart(spark, SF)
    assert asked == {"most_passes": 8}
