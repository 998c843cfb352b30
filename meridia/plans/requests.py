"""Checks of requests before a plan is made: the first rule that a request breaks, as a sentence, or None."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from meridia.functions import rf

Rule = Callable[[Mapping], str | None]

#: Inclusive bounds of numbers in requests.
BOUNDS = {
    "rays": (8, 720), "radius_m": (25, 5000), "tx_power_dbm": (0, 60), "beam_width": (10, 360), "calibration_offset_db": (-40, 40), "noise_figure_db": (0, 20), "sample_spacing_m": (20, 200),
    "path_spacing_m": (2, 100), "cell_size_m": (10, 250), "antenna_height_m": (0.5, 300), "receiver_height_m": (0.1, 100), "bandwidth_mhz": (0.1, 2000), "antenna_gain_dbi": (-20, 80), "system_loss_db": (0, 100), "results": (1, 10),
}
#: How many cells a request may name, by kind; bytes of an id; steps of rays in one simulation.
CELLS = {"network": (2, 8), "interference": (2, 8), "recommendation": (0, 5), "measurement": (1, 6)}
MOST_ID_BYTES, MOST_SEGMENTS, SEGMENT_M = 128, 25_000, 25.0


def number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def within(name: str) -> Rule:
    low, high = BOUNDS[name]
    return lambda r: None if number(r.get(name)) and low <= r[name] <= high else f"{name} must be between {low} and {high}"


def one_of(name: str, *values) -> Rule:
    return lambda r: None if r.get(name) in values else f"{name} must be {' or '.join(map(str, values))}"


def share(name: str) -> Rule:
    return lambda r: None if number(r.get(name)) and 0 < r[name] <= 1 else f"{name} must be greater than 0 and no more than 1"


def carrier(r: Mapping) -> str | None:
    """4g stays below 10 GHz, 5g takes 10 up to 100; the bandwidth is one the technology has."""
    tech, ghz = r.get("network_tech"), r.get("frequency_ghz")
    if not number(ghz) or not 0 < ghz < 100:
        return "frequency_ghz must be between 0 and 100"
    if (ghz < 10) != (tech == "4g"):
        return f"{tech} requires frequency_ghz {'below 10' if tech == '4g' else 'from 10 up to 100'}"
    if (tech, float(r.get("bandwidth_mhz") or 0)) not in rf.RESOURCE_BLOCKS:
        return f"bandwidth_mhz is not one of {tech}"
    return None


def cells(kind: str) -> Rule:
    low, high = CELLS[kind]

    def rule(r: Mapping) -> str | None:
        towers, seen = r.get("towers") or [], set()
        if not low <= len(towers) <= high:
            return f"towers must contain between {low} and {high} cells"
        for t in towers:
            name, place = t.get("id"), (t.get("lon"), t.get("lat"))
            if not isinstance(name, str) or not name.strip() or len(name.encode()) > MOST_ID_BYTES:
                return f"tower ids must be 1 to {MOST_ID_BYTES} bytes of text"
            if name in seen:
                return "tower ids must be unique"
            if not all(map(number, place)) or abs(place[0]) > 180 or abs(place[1]) > 90:
                return "each tower must have a valid lon and lat"
            seen.add(name)
        return None

    return rule


def segments(r: Mapping) -> str | None:
    """The work of a simulation: rays times their steps."""
    return None if r["rays"] * math.ceil(r["radius_m"] / SEGMENT_M) <= MOST_SEGMENTS else f"rays and radius_m ask for more than {MOST_SEGMENTS} segments"


def texts(*names: str) -> Rule:
    """Names (dots lead into nested objects) that must hold text."""

    def rule(r: Mapping) -> str | None:
        for name in names:
            if not isinstance(found := inside(r, name), str) or not found.strip():
                return f"{name} is required"
        return None

    return rule


def inside(r: Mapping, name: str):
    for part in name.split("."):
        r = r.get(part) if isinstance(r, Mapping) else None
    return r


def positive(*names: str) -> Rule:
    return lambda r: next((f"{n} must be greater than 0" for n in names if not (number(x := inside(r, n)) and x > 0)), None)


def exactly(name: str, *values) -> Rule:
    return lambda r: None if inside(r, name) in values else f"{name} must be {' or '.join(map(str, values))}"


def day(name: str) -> Rule:
    return lambda r: None if isinstance(x := inside(r, name), str) and re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", x) else f"{name} must be YYYY-MM-DD"


def filled(*names: str) -> Rule:
    return lambda r: next((f"{n} must not be empty" for n in names if not inside(r, n)), None)


def transmitters(r: Mapping) -> str | None:
    """Entries of a transmitter map: known once, placed, with all numbers stated."""
    seen, observed = set(), set()
    for i, e in enumerate(r.get("entries") or []):
        if not all(isinstance(e.get(k), str) and e[k].strip() for k in ("cell_id", "site_id")):
            return f"entries[{i}] needs cell_id and site_id"
        key = (str(e.get("plmn", "")).strip(), str(e.get("observed_cell_id", "")).strip())
        if e["cell_id"] in seen or (key[1] and key in observed):
            return f"entries[{i}] occurs twice"
        if not all(map(number, (e.get("lon"), e.get("lat")))) or abs(e["lon"]) > 180 or abs(e["lat"]) > 90:
            return f"entries[{i}] must have a valid lon and lat"
        if missing := next((k for k in STATED if not number(e.get(k))), None):
            return f"entries[{i}].{missing} must be stated"
        if min(abs(e["frequency_ghz"] - 2.6), abs(e["frequency_ghz"] - 28)) > 0.01:
            return f"entries[{i}].frequency_ghz must be 2.6 or 28"
        seen.add(e["cell_id"])
        observed.add(key)
    return None if r.get("entries") else "entries must not be empty"


#: Numbers that a transmitter's entry states.
STATED = ("antenna_height_m", "azimuth_deg", "tilt_deg", "frequency_ghz", "bandwidth_mhz", "tx_power_dbm")
TECH = one_of("network_tech", "4g", "5g")
RULES: dict[str, tuple[Rule, ...]] = {
    "simulation": (within("rays"), within("radius_m"), within("tx_power_dbm"), within("beam_width"), within("calibration_offset_db"), segments),
    "network": (cells("network"), within("rays"), within("radius_m"), within("tx_power_dbm"), within("beam_width"), within("calibration_offset_db"), segments),
    "interference": (TECH, cells("interference"), within("radius_m"), carrier, within("tx_power_dbm"), within("beam_width"), share("load_factor"), one_of("reuse_factor", 1, 3), within("noise_figure_db"), within("sample_spacing_m"), within("calibration_offset_db")),
    "recommendation": (TECH, cells("recommendation"), within("results"), within("radius_m"), carrier, within("tx_power_dbm"), within("beam_width")),
    "measurement": (TECH, cells("measurement"), within("radius_m"), within("tx_power_dbm"), within("beam_width"), within("calibration_offset_db"), carrier),
    "profile": (within("antenna_height_m"), within("receiver_height_m"), within("bandwidth_mhz"), within("antenna_gain_dbi"), within("system_loss_db")),
    "path": (within("path_spacing_m"),),
    "surface": (within("cell_size_m"),),
    "campaign": (
        exactly("schema_version", 1), texts("campaign_id", "campaign_version", "title"), day("campaign_date"), exactly("source_type", "synthetic_controlled", "local_field"), texts("collection_mode"), exactly("raw_format", "SIGNAL_COLLECTOR_TXT_V6"),
        exactly("raw_preservation.keep_raw", True), exactly("raw_preservation.canonical_separate", True), exactly("raw_preservation.no_overwrite", True), exactly("raw_preservation.hash_algorithm", "sha256", "SHA256"), texts("collector.name", "collector.version"), exactly("collector.root_required", False, None),
        texts("device.pseudonymous_id", "device.antenna_id"), positive("receiver.height_agl_m"), exactly("receiver.height_source", "measured", "configured", "assumed"), texts("coordinate.provider", "coordinate.crs"), positive("coordinate.max_accuracy_m"), exactly("coordinate.normalize_to_utc", True),
        texts("measurement.mode", "measurement.censoring_limitation"), positive("measurement.sampling_interval_ms", "measurement.fixed_point_window_seconds"), exactly("measurement.aggregation_method", "raw"), exactly("measurement.preserve_repeated_samples", True), filled("known_limitations", "privacy.personal_identifiers_excluded"), texts("privacy.sharing_policy"),
    ),
    "transmitter_map": (exactly("schema_version", 1), texts("map_id", "map_version", "source_citation"), transmitters),
}


def first_violation(kind: str, request: Mapping) -> str | None:
    return next((said for rule in RULES[kind] if (said := rule(request))), None)
