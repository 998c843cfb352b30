"""The data source of campaigns: parts of files, what can't be read, and what a measurement is when levels disagree."""

import json

from meridia.sources import observations

FLAGS = {"antenna_gain_embedded": True, "cable_loss_embedded": True, "calibration_applied": True}
SETUP = {"directionality": "isotropic", "comparison_basis": "isotropic_equivalent_path_loss"}


def load(spark, path, **options):
    observations.register(spark)
    return spark.read.format("observations").options(**options).load(str(path))


def one(spark, tmp_path, record, **campaign):
    (tmp_path / "c.json").write_text(json.dumps({"campaign_id": "c", "antenna_setup": SETUP, "measurements": [{"measurement_id": "m"} | record]} | campaign))
    return observations.normalised(load(spark, tmp_path / "c.json")).first()


def test_files_of_lines_are_read_in_parts(spark, tmp_path):
    for f in range(3):
        lines = [json.dumps({"campaign_id": f"{f}-{i}", "measurements": [{"measurement_id": str(k), "frequency_ghz": i} for k in range(i % 4)]}) for i in range(60)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines) + ("\n" if f else ""))
    (tmp_path / "_SUCCESS").write_text("")
    whole = sorted(map(tuple, load(spark, tmp_path, lines="true").select("campaign_id", "measurement_id", "ghz").collect()))
    assert len(whole) == 3 * sum(i % 4 for i in range(60))
    for size in (50, 97, 1000):
        parts = load(spark, tmp_path, lines="true", part_bytes=str(size))
        assert sorted(map(tuple, parts.select("campaign_id", "measurement_id", "ghz").collect())) == whole
    assert load(spark, tmp_path, lines="true", part_bytes="1000").rdd.getNumPartitions() > 10


def test_what_cannot_be_read_is_named(spark, tmp_path):
    (tmp_path / "a.json").write_text("{broken")
    (tmp_path / "b.json").write_text(json.dumps([5, {"measurements": []}, {"campaign_id": "x", "measurements": [{}, {"measurement_id": "1"}, {"measurement_id": "1"}, 7]}]))
    (tmp_path / "d.json").write_text(json.dumps({"campaigns": [{"campaign_id": "y", "measurements": [{"measurement_id": "2", "frequency_ghz": "high", "tx": 3}]}]}))
    rows = load(spark, tmp_path).collect()
    assert sorted((r.campaign_id or "", r.problem or "") for r in rows) == sorted([("", "invalid_json"), ("", "invalid_campaign"), ("", "campaign_id_missing"), ("x", "measurement_id_missing"), ("x", ""), ("x", "duplicate_measurement_id"), ("x", "measurement_id_missing"), ("y", "")])
    y = next(r for r in rows if r.campaign_id == "y")
    assert y.ghz is None and y.tx_lon is None and y.file.endswith("d.json")


def test_the_record_outranks_the_site_and_the_site_the_campaign(spark, tmp_path):
    environment = {"los_state": "NLOS", "los_source": "c", "morphology": "highrise", "morphology_source": "c", "rooftop_relation": "below_rooftop", "rooftop_source": "c"}
    sites = [{"site_id": "s", "morphology": "suburban", "morphology_source": "s"}, {"site_id": "s", "morphology": "second of the name"}]
    more = {"environment": environment, "sites": sites, "frequency_range_ghz": {"min_ghz": 28, "max_ghz": 28}, "weather": {"temperature_k": 280, "rain_known": True}}
    r = one(spark, tmp_path, {}, **more)
    assert (r.los, r.los_source, r.morphology, r.morphology_source, r.rooftop, r.ghz, r.kelvin, r.rain_known) == ("nlos", "c", "urban_high_rise", "c", "both_below_rooftop", 28.0, 280.0, True)
    r = one(spark, tmp_path, {"site_id": "s", "frequency_ghz": 140.5}, **more)
    assert (r.morphology, r.morphology_source, r.ghz) == ("suburban", "s", 140.5)
    r = one(spark, tmp_path, {"site_id": "s", "labels": {"los_nlos": "line-of-sight", "morphology": "a gorge"}, "weather": {"pressure_hpa": 900}}, **more)
    assert (r.los, r.los_source, r.morphology, r.morphology_source, r.kelvin, r.pressure_hpa, r.rain_known) == ("los", None, "a gorge", None, None, 900.0, None)
    r = one(spark, tmp_path, {}, frequency_range_ghz={"min_ghz": 1, "max_ghz": 2}, weather={"rain_known": True})
    assert r.ghz is None and r.rain_known is None


def test_one_path_loss_from_any_quantity(spark, tmp_path):
    def said(record, **campaign):
        r = one(spark, tmp_path, record, **campaign)
        return r.measured_db, r.reason

    loss = {"measurement_quantity": "path_loss", "measured_path_loss_db": 101.5} | FLAGS
    assert said(loss) == (101.5, None)
    assert said(loss | {"calibration_applied": None}) == (None, "flags_missing")
    assert said(loss | {"measured_path_loss_db": None}) == (None, "path_loss_missing")
    assert said(loss | {"directionality": "best_directional"}) == (None, "directional")
    assert said(loss | {"antenna_comparison_basis": "unknown"}) == (None, "basis")
    assert said(loss, antenna_setup={"comparison_basis": SETUP["comparison_basis"]}) == (None, "directionality_missing")
    assert said(loss | {"measurement_quantity": "directional_path_loss"}) == (None, "directional")
    assert said({"measurement_quantity": "path_gain", "measured_path_gain_db": -99.0} | FLAGS) == (99.0, None)
    power = {"measurement_quantity": "received_power", "measured_received_power_dbm": -70.0, "tx_conducted_power_dbm": 30.0, "tx_gain_dbi": 10.0, "rx_gain_dbi": 2.0, "tx_cable_loss_db": 1.0}
    assert said(power) == (None, "calibration_missing")
    calibration = {"rx_cable_loss_db": 0.5, "receiver_calibration_applied": True, "conducted_tx_power_dbm": 99.0}
    assert said(power, calibration=calibration) == (110.5, None)
    assert said(power, calibration=calibration | {"receiver_calibration_applied": False}) == (None, "not_calibrated")
    assert said({"measurement_quantity": "another"}) == (None, "quantity") == said({})
