"""Radio formulas as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors of serviceability (inclusive), default sensitivity (strict), thermal density at 290 K.
MIN_RSRP, MIN_SINR, MIN_RSRQ = -110.0, 0.0, -20.0
SENSITIVITY_DBM = -115.0
BUILDING_SERVICE_DBM = -100.0
THERMAL_DBM_HZ, REFERENCE_K = -174.0, 290.0
#: Resource blocks by technology and bandwidth in MHz, and subcarrier spacing in kHz.
RESOURCE_BLOCKS = {("4g", 1.4): 6, ("4g", 3.0): 15, ("4g", 5.0): 25, ("4g", 10.0): 50, ("4g", 15.0): 75, ("4g", 20.0): 100, ("5g", 50.0): 32, ("5g", 100.0): 66, ("5g", 200.0): 132, ("5g", 400.0): 264}
SPACING_KHZ = {"4g": 15.0, "5g": 120.0}
#: Wall loss in dB below 10 GHz, below 100 GHz, and above.
WALL_LOSS = ((10.0, 8.0), (100.0, 30.0), (float("inf"), 80.0))


def free_space_loss(metres: Column, ghz: Column) -> Column:
    return 20 * F.log10(F.greatest(metres, F.lit(1.0))) + 20 * F.log10(ghz) + 32.45


def wall_loss(ghz: Column) -> Column:
    return F.when(ghz < WALL_LOSS[0][0], WALL_LOSS[0][1]).when(ghz < WALL_LOSS[1][0], WALL_LOSS[1][1]).otherwise(WALL_LOSS[2][1])


def reach_m(eirp_dbm: Column, ghz: Column, loss_db: Column, sensitivity=SENSITIVITY_DBM) -> Column:
    """The distance at which free-space power falls to the sensitivity."""
    return F.when(ghz > 0, F.pow(F.lit(10.0), (eirp_dbm - sensitivity - loss_db - 20 * F.log10(ghz) - 32.45) / 20)).otherwise(0.0)


def milliwatts(dbm: Column) -> Column:
    return F.pow(F.lit(10.0), dbm / 10)


def dbm(mw: Column) -> Column:
    return F.when(mw > 0, 10 * F.log10(mw)).otherwise(float("-inf"))


def thermal_noise(hz: Column, figure_db: Column, kelvin=REFERENCE_K) -> Column:
    return THERMAL_DBM_HZ + 10 * F.log10(F.lit(kelvin) / REFERENCE_K) + 10 * F.log10(hz) + figure_db


def resource_blocks(tech: Column, mhz: Column) -> Column:
    out = F.lit(None).cast("int")
    for (t, b), n in RESOURCE_BLOCKS.items():
        out = F.when((tech == t) & (mhz == b), n).otherwise(out)
    return out


def spacing_khz(tech: Column) -> Column:
    return F.when(tech == "4g", SPACING_KHZ["4g"]).when(tech == "5g", SPACING_KHZ["5g"])


def slant_m(ground: Column, transmitter_m: Column, receiver_m: Column) -> Column:
    return F.sqrt(ground * ground + F.pow(transmitter_m - receiver_m, 2))


def capped_square(offset: Column, width: Column, cap: float) -> Column:
    """A parabolic pattern cut in dB; none where the width is nil."""
    return F.when(width > 0, F.least(F.lit(cap), 12 * F.pow(F.abs(offset) / width, 2))).otherwise(0.0)


def pattern_loss(horizontal: Column, vertical: Column, off_azimuth: Column, off_tilt: Column, beam: Column) -> Column:
    """Attenuation of four horizontal and three vertical patterns; the element pattern caps both cuts together."""
    flat = {"panel-10deg": 10.0, "panel-20deg": 20.0}
    tilt = F.lit(0.0)
    for name, width in flat.items():
        tilt = F.when(vertical == name, capped_square(off_tilt, F.lit(width), 30.0)).otherwise(tilt)
    element = F.least(F.lit(30.0), capped_square(off_azimuth, F.lit(65.0), 30.0) + capped_square(off_tilt, F.lit(65.0), 30.0))
    sector = capped_square(off_azimuth, F.greatest(beam / 2, F.lit(1.0)), 30.0)
    return F.when(horizontal == "3gpp-single-element", element).otherwise(F.when(horizontal == "cosine-sector", sector).otherwise(0.0) + tilt)


def tilt_offset(ground: Column, transmitter_m: Column, receiver_m: Column, downtilt: Column) -> Column:
    return F.degrees(F.atan2(transmitter_m - receiver_m, F.greatest(ground, F.lit(0.1)))) - downtilt


def urban_loss(ground: Column, slant: Column, ghz: Column, transmitter_m: Column, receiver_m: Column, line_of_sight: Column) -> Column:
    """Urban macro path loss with its breakpoint; without line of sight never below that with it."""
    breakpoint_m = 4 * (transmitter_m - 1) * (receiver_m - 1) * ghz * 1e9 / 3e8
    log_d, log_f = F.log10(F.greatest(slant, F.lit(1.0))), 20 * F.log10(ghz)
    near = 28 + 22 * log_d + log_f
    far = 28 + 40 * log_d + log_f - 9 * F.log10(breakpoint_m * breakpoint_m + F.pow(transmitter_m - receiver_m, 2))
    seen = F.when(ground > breakpoint_m, far).otherwise(near)
    hidden = F.greatest(seen, 13.54 + 39.08 * log_d + log_f - 0.6 * (receiver_m - 1.5))
    return F.when(line_of_sight, seen).otherwise(hidden)


def urban_refusal(ground: Column, ghz: Column, transmitter_m: Column, receiver_m: Column, outdoor: Column, has_buildings: Column, state: Column) -> Column:
    """The first rule that keeps the urban model from a link, or null."""
    return (
        F.when((ghz <= 0.5) | (ghz >= 100), "frequency_out_of_range")
        .when(F.isnan(ground) | ~ground.between(10, 5000), "distance_out_of_range")
        .when(~transmitter_m.between(10, 150) | (receiver_m < 1.5) | (receiver_m >= 13), "required_height_out_of_range")
        .when(~outdoor, "unsupported_endpoint_case")
        .when(~has_buildings, "required_building_data_missing")
        .when(~state.isin("los", "nlos"), "required_los_or_nlos_missing")
    )


def knife_edge_v(above_los: Column, from_tx: Column, to_rx: Column, ghz: Column) -> Column:
    wave = 0.299792458 / ghz
    return F.when((from_tx > 0) & (to_rx > 0) & (ghz > 0), above_los * F.sqrt(2 * (from_tx + to_rx) / (wave * from_tx * to_rx)))


def knife_edge_loss(v: Column) -> Column:
    return F.when(F.isnan(v) | (v <= -0.78), 0.0).otherwise(F.greatest(F.lit(0.0), 6.9 + 20 * F.log10(F.sqrt(F.pow(v - 0.1, 2) + 1) + v - 0.1)))


def entry_loss(ghz: Column, high: Column) -> Column:
    """Building-entry loss at 2.6 GHz (a constant) and 28 GHz (glass and concrete in parallel); null elsewhere."""
    mixed = lambda glass, share: 5 - 10 * F.log10(share * F.pow(F.lit(10.0), -glass / 10) + (1 - share) * F.pow(F.lit(10.0), -(5 + 4 * ghz) / 10))
    at_28 = F.when(high, mixed(25.4 + 0.11 * ghz, 0.7)).otherwise(mixed(2 + 0.2 * ghz, 0.3))
    return F.when(F.abs(ghz - 2.6) < 1e-6, 20.0).when(F.abs(ghz - 28) < 1e-6, at_28)


def serviceability_failures(rsrp: Column, sinr: Column, rsrq: Column) -> Column:
    rules = F.array(F.when(rsrp < MIN_RSRP, "rsrp"), F.when(sinr < MIN_SINR, "sinr"), F.when(rsrq < MIN_RSRQ, "rsrq"))
    return F.filter(rules, lambda r: r.isNotNull())


def quality_class(rsrp: Column, sinr: Column, rsrq: Column) -> Column:
    below = lambda a, b, c: (rsrp < a) | (sinr < b) | (rsrq < c)
    return F.when(below(-100, 0, -20), "poor").when(below(-90, 13, -15), "fair").when(below(-80, 20, -10), "good").otherwise("excellent")


def crossing_m(start_m: Column, end_m: Column, sensitivity_dbm: Column, power_dbm: Callable[[Column], Column], steps: int = 32) -> Column:
    """How far a power that falls with distance stays above the sensitivity: ``steps`` halvings of [start, end], the upper end of what is
    left. ``power_dbm`` is any column of the distance, so any registered loss can be asked."""
    low = F.greatest(start_m, F.lit(0.0))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        usable = power_dbm(mid) > sensitivity_dbm
        return F.struct(F.when(usable, mid).otherwise(s["low"]).alias("low"), F.when(usable, s["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.alias("low"), F.greatest(end_m, low).alias("high")), halve, lambda s: s["high"])
