"""Losses of air, rain and fog, and their composed ledger along a path; the street models' tables. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions import gas

#: Fixed values (ITU-R P.1411, below rooftop): model, line of sight, GHz range, metres range, alpha, beta, gamma, sigma.
STREET = (
    ("p1411_below_rooftop_los_v1", "los", 0.45, 300.0, 5.0, 660.0, 2.07, 31.23, 2.06, 4.91),
    ("p1411_urban_highrise_nlos_v1", "nlos", 0.8, 159.0, 20.0, 715.0, 3.73, 16.02, 2.26, 7.62),
    ("p1411_urban_lowrise_nlos_v1", "nlos", 0.45, 255.0, 10.0, 250.0, 4.52, 6.04, 2.14, 8.02),
)
#: Fixed values (ITU-R P.838-3): rain coefficients as Gaussians over log10 GHz (height, centre, width), slope and offset.
RAIN = {
    "k_h": (((-5.33980, -0.10008, 1.13098), (-0.35351, 1.26970, 0.45400), (-0.23789, 0.86036, 0.15354), (-0.94158, 0.64552, 0.16817)), -0.18961, 0.71147),
    "k_v": (((-3.80595, 0.56934, 0.81061), (-3.44965, -0.22911, 0.51059), (-0.39902, 0.73042, 0.11899), (0.50167, 1.07319, 0.27195)), -0.16398, 0.63297),
    "a_h": (((-0.14318, 1.82442, -0.55187), (0.29591, 0.77564, 0.19822), (0.32177, 0.63773, 0.13164), (-5.37610, -0.96230, 1.47828), (16.1721, -3.29980, 3.43990)), 0.67849, -1.95537),
    "a_v": (((-0.07771, 2.33840, -0.76284), (0.56727, 0.95545, 0.54039), (-0.20238, 1.14520, 0.26809), (-48.2991, 0.791669, 0.116226), (48.5833, 0.791459, 0.116479)), -0.053739, 0.83433),
}
#: The ranges that a composed ledger takes (GHz, metres, hPa, K, g/m3, mm/h, g/m3), and where rain and fog are defined.
GHZ, METRES, PRESSURE, KELVIN, VAPOUR, RAIN_RATE, FOG_WATER = (1.0, 1000.0), (0.01, 100_000.0), (300.0, 1100.0), (180.0, 330.0), (0.0, 100.0), (0.0, 500.0), (0.0, 5.0)
FOG_GHZ = 200.0


def rain_fit(name: str, ghz: Column) -> Column:
    terms, slope, offset = RAIN[name]
    x = F.log10(ghz)
    return sum((a * F.exp(-F.pow((x - b) / c, 2)) for a, b, c in terms), F.lit(0.0)) + slope * x + offset


def rain_loss(ghz: Column, mm_h: Column, vertical: bool = False) -> Column:
    """dB per km."""
    v = "v" if vertical else "h"
    return F.pow(F.lit(10.0), rain_fit(f"k_{v}", ghz)) * F.pow(mm_h, rain_fit(f"a_{v}", ghz))


def fog_loss(ghz: Column, kelvin: Column) -> Column:
    """dB per km for 1 g of liquid water in a cubic metre (double-Debye water)."""
    x = 300 / kelvin - 1
    e0 = 77.66 + 103.3 * x
    e1, e2 = 0.0671 * e0, 3.52
    fp = 20.20 - 146 * x + 316 * x * x
    fs = 39.8 * fp
    relaxed = lambda d, f: d / (1 + F.pow(ghz / f, 2))
    real = relaxed(e0 - e1, fp) + relaxed(e1 - e2, fs) + e2
    loss = ghz / fp * relaxed(e0 - e1, fp) + ghz / fs * relaxed(e1 - e2, fs)
    return 0.819 * ghz / (loss * (1 + F.pow((2 + real) / loss, 2)))


def street_reach(model: Column, ghz: Column, most: Column) -> Column:
    """The candidates' distance limits shrink at high frequencies."""
    los = F.when(ghz > 255, 155.0).when(ghz > 159, 250.0).when(ghz > 82, 500.0).otherwise(most)
    high = F.when(ghz > 82, 150.0).otherwise(most)
    low = F.when(ghz > 159, 80.0).when(ghz > 73, 150.0).otherwise(most)
    return F.when(F.endswith(model, F.lit("below_rooftop_los_v1")), los).when(F.endswith(model, F.lit("highrise_nlos_v1")), high).otherwise(low)


def rain_loss_tilted(ghz: Column, mm_h: Column, elevation: Column, tilt: Column) -> Column:
    """dB per km for a path's elevation and a polarisation's tilt (degrees; 45 is circular)."""
    k, alpha = gas.rain_path(F.pow(F.lit(10.0), rain_fit("k_h", ghz)), rain_fit("a_h", ghz), F.pow(F.lit(10.0), rain_fit("k_v", ghz)), rain_fit("a_v", ghz), elevation, tilt)
    return F.when(mm_h > 0, k * F.pow(mm_h, alpha)).otherwise(0.0)


def ledger(ghz: Column, slant_m: Column, height_m: Column, kelvin: Column, pressure_hpa: Column, vapour_g_m3: Column, rain_mm_h: Column, fog_g_m3: Column, tilt: Column | None = None, oxygen=gas.OXYGEN_LINES, water=gas.WATER_LINES) -> dict[str, Column]:
    """Free space, gas, rain and fog in dB along a path, and their total. The pressure is that of the whole air; ``height_m`` is what the
    ends differ in. Rain or fog that is null is left out; fog is defined up to 200 GHz and 0 beyond."""
    km = slant_m / 1000
    ground = F.sqrt(F.greatest(slant_m * slant_m - height_m * height_m, F.lit(0.0)))
    elevation = F.abs(F.degrees(F.atan2(height_m, F.greatest(ground, F.lit(1e-9)))))
    dry = pressure_hpa - gas.vapour_pressure(vapour_g_m3, kelvin)
    parts = {
        "free_space": 20 * F.log10(4 * F.pi() * slant_m * ghz * 1e9 / 299_792_458.0),
        "gas": km * gas.specific(ghz, dry, kelvin, vapour_g_m3, oxygen, water),
        "rain": km * F.when(rain_mm_h.isNotNull() & ghz.between(*GHZ), rain_loss_tilted(ghz, rain_mm_h, elevation, F.lit(45.0) if tilt is None else tilt)).otherwise(0.0),
        "fog": km * F.when(fog_g_m3.isNotNull() & (ghz <= FOG_GHZ), fog_loss(ghz, kelvin) * fog_g_m3).otherwise(0.0),
    }
    return parts | {"total": parts["free_space"] + parts["gas"] + parts["rain"] + parts["fog"]}


def ledger_refusal(ghz: Column, slant_m: Column, kelvin: Column, pressure_hpa: Column, vapour_g_m3: Column, rain_mm_h: Column, fog_g_m3: Column) -> Column:
    """The first range that a path's ledger leaves, or null."""
    outside = lambda x, limits: ~F.coalesce(x.between(*limits), F.lit(False))
    return (
        F.when(outside(ghz, GHZ), "frequency_out_of_range").when(outside(slant_m, METRES), "distance_out_of_range").when(outside(pressure_hpa, PRESSURE) | outside(kelvin, KELVIN) | outside(vapour_g_m3, VAPOUR), "atmosphere_out_of_range")
        .when(rain_mm_h.isNotNull() & outside(rain_mm_h, RAIN_RATE), "rain_out_of_range").when(fog_g_m3.isNotNull() & (outside(fog_g_m3, FOG_WATER) | outside(kelvin, KELVIN)), "fog_out_of_range")
    )
