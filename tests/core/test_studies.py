"""Request checks, tolerances, composites."""

from pyspark.sql import functions as F

from meridia.plans import requests, studies


def test_requests():
    good = {"network_tech": "5g", "towers": [{"id": "a", "lon": 32.8, "lat": 39.9}, {"id": "b", "lon": 32.9, "lat": 39.9}], "rays": 120, "radius_m": 400, "frequency_ghz": 28, "bandwidth_mhz": 100, "tx_power_dbm": 30, "beam_width": 120, "load_factor": 1, "reuse_factor": 3, "noise_figure_db": 7, "sample_spacing_m": 50, "calibration_offset_db": 0, "results": 3}
    assert all(requests.first_violation(k, good) is None for k in ("simulation", "network", "interference", "recommendation", "measurement"))
    for kind, change, said in (
        ("simulation", {"rays": 7}, "rays must be between 8 and 720"), ("simulation", {"rays": 720, "radius_m": 5000}, "rays and radius_m ask for more than 25000 segments"), ("network", {"towers": good["towers"][:1]}, "towers must contain between 2 and 8 cells"),
        ("network", {"towers": [good["towers"][0]] * 2}, "tower ids must be unique"), ("network", {"towers": [good["towers"][0], {"id": "b", "lon": 181, "lat": 0}]}, "each tower must have a valid lon and lat"), ("interference", {"network_tech": "6g"}, "network_tech must be 4g or 5g"),
        ("interference", {"frequency_ghz": 2.6}, "5g requires frequency_ghz from 10 up to 100"), ("interference", {"bandwidth_mhz": 20}, "bandwidth_mhz is not one of 5g"), ("interference", {"load_factor": 0}, "load_factor must be greater than 0 and no more than 1"), ("interference", {"reuse_factor": 2}, "reuse_factor must be 1 or 3"), ("simulation", {"beam_width": float("nan")}, "beam_width must be between 10 and 360"),
    ):
        assert requests.first_violation(kind, good | change) == said


def test_campaign_manifests():
    good = {
        "schema_version": 1, "campaign_id": "c", "campaign_version": "1", "title": "t", "campaign_date": "2026-10-02", "source_type": "local_field", "collection_mode": "walk", "raw_format": "SIGNAL_COLLECTOR_TXT_V6", "raw_preservation": {"keep_raw": True, "canonical_separate": True, "no_overwrite": True, "hash_algorithm": "sha256"},
        "collector": {"name": "n", "version": "6", "root_required": False}, "device": {"pseudonymous_id": "d", "antenna_id": "a"}, "receiver": {"height_agl_m": 1.5, "height_source": "measured"}, "coordinate": {"provider": "gnss", "crs": "EPSG:4326", "max_accuracy_m": 10, "normalize_to_utc": True},
        "measurement": {"mode": "idle", "sampling_interval_ms": 1000, "fixed_point_window_seconds": 60, "aggregation_method": "raw", "preserve_repeated_samples": True, "censoring_limitation": "c"}, "known_limitations": ["x"], "privacy": {"personal_identifiers_excluded": ["imsi"], "sharing_policy": "none"},
    }
    assert requests.first_violation("campaign", good) is None
    for change, said in (({"campaign_date": "2026-13-01"}, "campaign_date must be YYYY-MM-DD"), ({"receiver": {"height_source": "measured"}}, "receiver.height_agl_m must be greater than 0"), ({"device": {"antenna_id": "a"}}, "device.pseudonymous_id is required"), ({"known_limitations": []}, "known_limitations must not be empty"), ({"collector": {"name": "n", "version": "6", "root_required": True}}, "collector.root_required must be False or None")):
        assert requests.first_violation("campaign", good | change) == said
    entry = {"cell_id": "a", "site_id": "s", "lon": 32.8, "lat": 39.9, "observed_cell_id": "7", "plmn": "286", "antenna_height_m": 25, "azimuth_deg": 0, "tilt_deg": 4, "frequency_ghz": 2.6, "bandwidth_mhz": 20, "tx_power_dbm": 40}
    whole = {"schema_version": 1, "map_id": "m", "map_version": "1", "source_citation": "s"}
    assert requests.first_violation("transmitter_map", whole | {"entries": [entry]}) is None
    for entries, said in (([], "entries must not be empty"), ([entry, entry], "entries[1] occurs twice"), ([entry, entry | {"cell_id": "b"}], "entries[1] occurs twice"), ([entry | {"tilt_deg": None}], "entries[0].tilt_deg must be stated"), ([entry | {"frequency_ghz": 140}], "entries[0].frequency_ghz must be 2.6 or 28")):
        assert requests.first_violation("transmitter_map", whole | {"entries": entries}) == said


def test_composite_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([(1.0, None), (None, 0.5), (None, None), (1.0, 0.0)], "a double, b double")
    u = {"a": F.col("a"), "b": F.col("b")}
    assert [r.v for r in df.select(studies.composite(u, {"a": 3.0, "b": 1.0}).alias("v")).collect()] == [1.0, 0.5, None, 0.75]


def test_viewport_across_the_antimeridian(spark):
    df = spark.createDataFrame([(175.0,), (-175.0,), (170.0,), (-172.0,), (160.0,), (-160.0,)], "lon double")
    assert [r.v for r in df.select(studies.in_viewport(F.col("lon"), F.lit(0.0), 170.0, -10.0, -172.0, 10.0).alias("v")).collect()] == [True, True, True, True, False, False]
    assert [r.v for r in df.select(studies.in_viewport(F.col("lon"), F.lit(0.0), -180.0, -10.0, 180.0, 10.0).alias("v")).collect()] == [True] * 6


def test_tolerances_count_every_class(spark):
    p = spark.createDataFrame([(3.0, True), (-1.0, True), (0.5, True), (None, False)], "least double, complete boolean")
    got = {(r.margin_m, r["class"]): r.n for r in studies.tolerance_counts(p, (0.0, 1.0)).collect()}
    assert got == {(0.0, "clear"): 2, (0.0, "obstruction_candidate"): 1, (0.0, "near_uncertainty"): 0, (0.0, "unavailable"): 1, (1.0, "clear"): 1, (1.0, "obstruction_candidate"): 0, (1.0, "near_uncertainty"): 2, (1.0, "unavailable"): 1}
