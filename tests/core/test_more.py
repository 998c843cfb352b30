"""Gas, polygon overlap, facades, collector cells, searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import gas, geo, polygons
from meridia.sources import collector


def test_absorption_matches_a_plain_sum(spark):
    o = [(118.750334, 940.3, 0.01, 16.64, 0.0, -0.439, 0.079), (60.306056, 2102.6, 0.0, 15.0, 0.0, 5.0, -0.1)]
    w = [(22.23508, 0.1079, 2.144, 26.38, 0.76, 5.087, 1.0), (183.310087, 2.273, 0.668, 29.06, 0.77, 5.022, 0.85)]
    p = [(1, 60.0, 1013.25, 288.15, 7.5), (2, 140.0, 900.0, 300.0, 0.0)]
    df = spark.createDataFrame(p, "id int, ghz double, dry_hpa double, kelvin double, grams_m3 double")
    got = {r.id: r for r in gas.absorption(df, spark.createDataFrame(o, list(gas.OXYGEN)), spark.createDataFrame(w, list(gas.WATER)), ["id"]).collect()}
    for i, f, d, t, rho in p:
        th, e, ox, wa = 300 / t, rho * t / 216.7, 0.0, 0.0
        for f0, a1, a2, a3, a4, a5, a6 in o:
            width = ((a3 * 1e-4 * (d * th ** (0.8 - a4) + 1.1 * e * th)) ** 2 + 2.25e-6) ** 0.5
            de = (a5 + a6 * th) * 1e-4 * (d + e) * th**0.8
            ox += a1 * 1e-7 * d * th**3 * np.exp(a2 * (1 - th)) * f / f0 * ((width - de * (f0 - f)) / ((f0 - f) ** 2 + width**2) + (width - de * (f0 + f)) / ((f0 + f) ** 2 + width**2))
        for f0, b1, b2, b3, b4, b5, b6 in w:
            x = b3 * 1e-4 * (d * th**b4 + b5 * e * th**b6)
            width = 0.535 * x + (0.217 * x * x + 2.1316e-12 * f0 * f0 / th) ** 0.5
            wa += b1 * 0.1 * e * th**3.5 * np.exp(b2 * (1 - th)) * f / f0 * (width / ((f0 - f) ** 2 + width**2) + width / ((f0 + f) ** 2 + width**2))
        assert got[i].oxygen == pytest.approx(0.182 * f * ox) and got[i].water == pytest.approx(0.182 * f * wa)
        assert got[i].total == pytest.approx(got[i].oxygen + got[i].water + got[i].dry) and got[i].dry > 0


def test_overlap_of_polygons(spark):
    a = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert polygons.iou(a, a + 1) == pytest.approx(1 / 7) and polygons.iou(a, a[::-1]) == pytest.approx(1.0) and polygons.iou(a, a + 5) == 0.0
    notched = np.array([(0, 0), (2, 0), (2, 2), (1, 1), (0, 2)], float)
    assert polygons.iou(a, notched) == pytest.approx(0.75, abs=0.02)
    rings = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]), (None, [(1.0, 1.0)])], "a array<struct<lon:double,lat:double>>, b array<struct<lon:double,lat:double>>")
    assert [r.v for r in rings.select(polygons.overlap("a", "b").alias("v")).collect()] == pytest.approx([1 / 7, 0.0])


def test_facade(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.001, -0.001), (0.002, -0.001), (0.002, 0.001), (0.001, 0.001))))
    end = (F.lit(0.0), F.lit(0.0), F.lit(0.0015), F.lit(0.0))
    share = polygons.facade_share(*end, ring, geo.distance_m(end[0], end[1], end[2], end[3]))
    assert spark.range(1).select(share.alias("v")).first().v == pytest.approx(2 / 3)
    outside = polygons.facade_share(F.lit(0.0), F.lit(0.0), F.lit(0.01), F.lit(0.0), ring, F.lit(1113.2))
    assert spark.range(1).select(outside.alias("v")).first().v is None


def test_collector_cells(spark):
    rows = spark.createDataFrame(
        [("f", 1, "s", 10, {"record_type": "cell", "technology": "LTE", "registered": "true", "connection_status": "PRIMARY_SERVING", "cell_id": "7", "pci": "3", "frequency_mhz": "2665", "rsrp": "-82", "rsrq": "x"}), ("f", 2, "s", 20, {"record_type": "cell", "technology": "LTE", "registered": "true", "connection_status": "NONE", "cell_id": "", "rsrp": "-90", "rssi": "-70"}), ("f", 3, "s", 30, {"record_type": "fix"})],
        "file string, line int, session_id string, epoch_ms long, payload map<string,string>",
    )
    c = collector.cells(rows)
    got = {r.line: r for r in c.collect()}
    assert set(got) == {1, 2} and (got[1].serving, got[1].pci, got[1].ghz, got[1].technology) == (True, 3, 2.665, "lte") and not got[2].serving and got[2].cell_id is None
    assert sorted((r.line, r.quantity, r.value) for r in collector.quantities(c).collect()) == [(1, "rsrp", -82.0), (2, "rsrp", -90.0), (2, "rssi", -70.0)]
    assert {(r.quantity, r.ghz): r.blockers for r in collector.readiness(c, 1).collect()}["rsrp", None] == ["frequency_unknown", "no_serving_rows"]
