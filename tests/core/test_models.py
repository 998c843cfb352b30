"""The model registry: every branch has a status of its own, the composed ledger equals a plain sum over the lines."""

import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import gas, models, weather

LINK = "distance_m double, ghz double, walls long, los string, transmitter_m double, receiver_m double, kelvin double, pressure_hpa double, vapour_g_m3 double, rain_known boolean, rain_mm_h double, fog_known boolean, fog_g_m3 double, morphology string, rooftop string, los_source string, morphology_source string, rooftop_source string"
PLAIN = dict(distance_m=1000.0, ghz=140.0, walls=1, los="los", transmitter_m=25.0, receiver_m=1.5, kelvin=288.15, pressure_hpa=1013.25, vapour_g_m3=7.5, rain_known=False, rain_mm_h=None, fog_known=False, fog_g_m3=None, morphology="suburban", rooftop="both_below_rooftop", los_source="d", morphology_source="d", rooftop_source="d")


def judged(spark, model, **changes):
    df = spark.createDataFrame([tuple((PLAIN | changes).values())], LINK)
    r = models.predictions(df, [model]).first()
    return r.status, r.reason, r.predicted_db


def plain_gas(ghz, hpa, kelvin, grams):
    theta, e = 300 / kelvin, grams * kelvin / 216.7
    dry = hpa - e
    oxygen = water = 0.0
    for f0, a1, a2, a3, a4, a5, a6 in gas.OXYGEN_LINES:
        w = math.sqrt((a3 * 1e-4 * (dry * theta ** (0.8 - a4) + 1.1 * e * theta)) ** 2 + 2.25e-6)
        d = (a5 + a6 * theta) * 1e-4 * (dry + e) * theta**0.8
        oxygen += a1 * 1e-7 * dry * theta**3 * math.exp(a2 * (1 - theta)) * ghz / f0 * sum((w - d * x) / (x * x + w * w) for x in (f0 - ghz, f0 + ghz))
    for f0, b1, b2, b3, b4, b5, b6 in gas.WATER_LINES:
        w = b3 * 1e-4 * (dry * theta**b4 + b5 * e * theta**b6)
        w = 0.535 * w + math.sqrt(0.217 * w * w + 2.1316e-12 * f0 * f0 / theta)
        water += b1 * 0.1 * e * theta**3.5 * math.exp(b2 * (1 - theta)) * ghz / f0 * sum(w / (x * x + w * w) for x in (f0 - ghz, f0 + ghz))
    wide = 5.6e-4 * (dry + e) * theta**0.8
    continuum = ghz * dry * theta**2 * (6.14e-5 / (wide * (1 + (ghz / wide) ** 2)) + 1.4e-12 * dry * theta**1.5 / (1 + 1.9e-5 * ghz**1.5))
    return 0.1820 * ghz * (oxygen + water + continuum)


def test_atmospheric_model_adds_gas_rain_and_fog(spark):
    free = 20 * math.log10(4 * math.pi * 1000 * 140e9 / 299_792_458.0)
    status, _, clear = judged(spark, "atmospheric")
    assert status == "applicable" and clear == pytest.approx(free + plain_gas(140.0, 1013.25, 288.15, 7.5), abs=1e-9)
    assert 0.5 < clear - free < 2  # about 1 dB a km at 140 GHz in such air
    _, _, dry = judged(spark, "atmospheric", rain_known=True, rain_mm_h=0.0)
    assert dry == pytest.approx(clear, abs=1e-9)
    _, _, wet = judged(spark, "atmospheric", rain_known=True, rain_mm_h=25.0)
    assert 8 < wet - clear < 15
    _, _, fog = judged(spark, "atmospheric", fog_known=True, fog_g_m3=0.5)
    assert 1 < fog - clear < 5
    assert judged(spark, "atmospheric", ghz=250.0, fog_known=True, fog_g_m3=0.5)[2] == pytest.approx(judged(spark, "atmospheric", ghz=250.0)[2], abs=1e-9)


@pytest.mark.parametrize("ghz", [22.2, 60.0, 118.75, 183.3, 557.0])
def test_gas_at_its_lines(spark, ghz):
    at = F.lit(ghz)
    got = spark.range(1).select(gas.specific(at, F.lit(1000.0), F.lit(290.0), F.lit(10.0)).alias("x")).first().x
    assert got == pytest.approx(plain_gas(ghz, 1000.0 + 10 * 290 / 216.7, 290.0, 10.0), rel=1e-9)


@pytest.mark.parametrize(
    "model, changes, status, reason",
    [
        ("atmospheric", {"kelvin": None}, "ambiguous", "weather_required"), ("atmospheric", {"rain_known": None}, "ambiguous", "weather_flags_required"), ("atmospheric", {"pressure_hpa": 100.0}, "unsupported", "atmosphere_out_of_range"),
        ("atmospheric", {"ghz": 1200.0}, "unsupported", "frequency_out_of_range"), ("atmospheric", {"rain_known": True, "rain_mm_h": 900.0}, "unsupported", "rain_out_of_range"), ("atmospheric", {"fog_known": True, "fog_g_m3": 9.0}, "unsupported", "fog_out_of_range"),
        ("research_sub_thz", {"walls": None}, "ambiguous", "wall_events_required"), ("research_sub_thz", {"ghz": 28.0}, "inapplicable", "frequency_out_of_range"), ("no such model", {}, "unsupported", "no_adapter_registered"),
        ("no such model", {"distance_m": 0.0}, "ambiguous", "frequency_and_distance_required"), ("p1411_below_rooftop_los_v1", {"morphology": "unknown"}, "ambiguous", "labels_required"), ("p1411_below_rooftop_los_v1", {"los_source": None}, "ambiguous", "labels_required"),
        ("p1411_below_rooftop_los_v1", {"distance_m": 501.0}, "inapplicable", "distance_out_of_range"), ("p1411_below_rooftop_los_v1", {"distance_m": 400.0, "los": "nlos"}, "inapplicable", "los_state_mismatch"),
        ("p1411_urban_highrise_nlos_v1", {"ghz": 200.0, "los": "nlos", "distance_m": 5000.0, "rooftop": "both_above_rooftop"}, "inapplicable", "frequency_out_of_range,morphology_mismatch,rooftop_relation_mismatch,unsupported_geometry"),
        ("p1411_urban_lowrise_nlos_v1", {"los": "nlos", "distance_m": 100.0}, "applicable", None), (" P525_FSPL ", {}, "applicable", None), ("single_edge_diffraction", {}, "unsupported", "edge_loss_required"),
    ],
)
def test_every_reason_has_its_status(spark, model, changes, status, reason):
    got = judged(spark, model, **changes)
    assert got[:2] == (status, reason) and (got[2] is not None) == (status == "applicable")


def test_street_model_value(spark):
    _, _, got = judged(spark, "p1411_urban_lowrise_nlos_v1", los="nlos", distance_m=100.0)
    assert got == pytest.approx(10 * 4.52 * 2 + 6.04 + 10 * 2.14 * math.log10(140))


def test_ledger_parts(spark):
    x = F.lit
    parts = weather.ledger(x(100.0), x(2000.0), x(1000.0), x(280.0), x(1000.0), x(5.0), x(10.0), x(0.1))
    r = spark.range(1).select(*(v.alias(k) for k, v in parts.items())).first()
    assert r.total == pytest.approx(r.free_space + r.gas + r.rain + r.fog) and min(r) > 0


def test_gas_lines_are_not_interpreted_row_by_row(spark):
    p = spark.createDataFrame([(i, 20.0 + 3.7 * i, 990.0 - i, 280.0 + i % 20, i % 12.0) for i in range(60)] + [(60, 30.0, None, 290.0, 1.0)], "id long, ghz double, dry_hpa double, kelvin double, grams_m3 double")
    got = p.select("id", gas.specific(*(F.col(c) for c in p.columns[1:])).alias("x"))
    want = gas.absorption(p, spark.createDataFrame(list(gas.OXYGEN_LINES), list(gas.OXYGEN)), spark.createDataFrame(list(gas.WATER_LINES), list(gas.WATER)), ["id"])
    rows = got.join(want.select("id", "total"), "id").collect()
    assert len(rows) == 61 and next(r.x for r in rows if r.id == 60) is None
    assert all(r.x == pytest.approx(r.total, rel=1e-9) for r in rows if r.id < 60)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan  # before, a lambda went through 79 lines for each row
