"""Rays are followed where they begin: no row is made of a wall or a step."""

import numpy as np
import pytest

from meridia.plans import catalogue, rays

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["simulation_stats", "sector_score", "ray_segments"])
def test_events_of_rays_are_no_rows(name, spark):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_a_ray_that_begins_in_a_footprint_or_on_its_edge():
    ray = {"cell_id": np.array([1]), "ray": np.array([0]), "lon": np.array([0.0]), "lat": np.array([0.0]), "bx": np.array([0.0]), "by": np.array([0.004]), "radius_m": np.array([400.0]), "ghz": np.array([2.6]), "loss_db": np.array([8.0])}
    boxes = {"building_id": np.arange(4), "lon": np.array([0.0, 0.0, 0.001, 0.0]), "lat": np.array([0.0, 0.002, 0.002, -0.0002]), "half": np.full(4, 0.0002)}
    (w,) = rays.walked(ray, boxes)
    assert w.box.tolist() == [1, 3]  # around the cell: none of its walls; beside the ray: not met; its north edge holds the cell, which is outside
    assert w.at.tolist() == pytest.approx([180.0, 0.0]) and (np.diff(w.d) >= 0).all() and len(w.d) == 16 + 3
