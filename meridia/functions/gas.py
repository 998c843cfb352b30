"""Gaseous absorption line by line, and rain coefficients for any path. Line tables are parameters; the published ones are the default."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators.tables import at_most

OXYGEN = ("f0", "a1", "a2", "a3", "a4", "a5", "a6")
WATER = ("f0", "b1", "b2", "b3", "b4", "b5", "b6")
#: Fixed values (ITU-R P.676-13, table 1): the spectral lines of oxygen, f0 (GHz), a1 to a6.
OXYGEN_LINES = (
    (50.474214, 0.975, 9.651, 6.69, 0.0, 2.566, 6.85),
    (50.987745, 2.529, 8.653, 7.17, 0.0, 2.246, 6.8),
    (51.50336, 6.193, 7.709, 7.64, 0.0, 1.947, 6.729),
    (52.021429, 14.32, 6.819, 8.11, 0.0, 1.667, 6.64),
    (52.542418, 31.24, 5.983, 8.58, 0.0, 1.388, 6.526),
    (53.066934, 64.29, 5.201, 9.06, 0.0, 1.349, 6.206),
    (53.595775, 124.6, 4.474, 9.55, 0.0, 2.227, 5.085),
    (54.130025, 227.3, 3.8, 9.96, 0.0, 3.17, 3.75),
    (54.67118, 389.7, 3.182, 10.37, 0.0, 3.558, 2.654),
    (55.221384, 627.1, 2.618, 10.89, 0.0, 2.56, 2.952),
    (55.783815, 945.3, 2.109, 11.34, 0.0, -1.172, 6.135),
    (56.264774, 543.4, 0.014, 17.03, 0.0, 3.525, -0.978),
    (56.363399, 1331.8, 1.654, 11.89, 0.0, -2.378, 6.547),
    (56.968211, 1746.6, 1.255, 12.23, 0.0, -3.545, 6.451),
    (57.612486, 2120.1, 0.91, 12.62, 0.0, -5.416, 6.056),
    (58.323877, 2363.7, 0.621, 12.95, 0.0, -1.932, 0.436),
    (58.446588, 1442.1, 0.083, 14.91, 0.0, 6.768, -1.273),
    (59.164204, 2379.9, 0.387, 13.53, 0.0, -6.561, 2.309),
    (59.590983, 2090.7, 0.207, 14.08, 0.0, 6.957, -0.776),
    (60.306056, 2103.4, 0.207, 14.15, 0.0, -6.395, 0.699),
    (60.434778, 2438.0, 0.386, 13.39, 0.0, 6.342, -2.825),
    (61.150562, 2479.5, 0.621, 12.92, 0.0, 1.014, -0.584),
    (61.800158, 2275.9, 0.91, 12.63, 0.0, 5.014, -6.619),
    (62.41122, 1915.4, 1.255, 12.17, 0.0, 3.029, -6.759),
    (62.486253, 1503.0, 0.083, 15.13, 0.0, -4.499, 0.844),
    (62.997984, 1490.2, 1.654, 11.74, 0.0, 1.856, -6.675),
    (63.568526, 1078.0, 2.108, 11.34, 0.0, 0.658, -6.139),
    (64.127775, 728.7, 2.617, 10.88, 0.0, -3.036, -2.895),
    (64.67891, 461.3, 3.181, 10.38, 0.0, -3.968, -2.59),
    (65.224078, 274.0, 3.8, 9.96, 0.0, -3.528, -3.68),
    (65.764779, 153.0, 4.473, 9.55, 0.0, -2.548, -5.002),
    (66.302096, 80.4, 5.2, 9.06, 0.0, -1.66, -6.091),
    (66.836834, 39.8, 5.982, 8.58, 0.0, -1.68, -6.393),
    (67.369601, 18.56, 6.818, 8.11, 0.0, -1.956, -6.475),
    (67.900868, 8.172, 7.708, 7.64, 0.0, -2.216, -6.545),
    (68.431006, 3.397, 8.652, 7.17, 0.0, -2.492, -6.6),
    (68.960312, 1.334, 9.65, 6.69, 0.0, -2.773, -6.65),
    (118.750334, 940.3, 0.01, 16.64, 0.0, -0.439, 0.079),
    (368.498246, 67.4, 0.048, 16.4, 0.0, 0.0, 0.0),
    (424.76302, 637.7, 0.044, 16.4, 0.0, 0.0, 0.0),
    (487.249273, 237.4, 0.049, 16.0, 0.0, 0.0, 0.0),
    (715.392902, 98.1, 0.145, 16.0, 0.0, 0.0, 0.0),
    (773.83949, 572.3, 0.141, 16.2, 0.0, 0.0, 0.0),
    (834.145546, 183.1, 0.145, 14.7, 0.0, 0.0, 0.0),
)
#: Fixed values (ITU-R P.676-13, table 2): the spectral lines of water vapour, f0 (GHz), b1 to b6.
WATER_LINES = (
    (22.23508, 0.1079, 2.144, 26.38, 0.76, 5.087, 1.0),
    (67.80396, 0.0011, 8.732, 28.58, 0.69, 4.93, 0.82),
    (119.99594, 0.0007, 8.353, 29.48, 0.7, 4.78, 0.79),
    (183.310087, 2.273, 0.668, 29.06, 0.77, 5.022, 0.85),
    (321.22563, 0.047, 6.179, 24.04, 0.67, 4.398, 0.54),
    (325.152888, 1.514, 1.541, 28.23, 0.64, 4.893, 0.74),
    (336.227764, 0.001, 9.825, 26.93, 0.69, 4.74, 0.61),
    (380.197353, 11.67, 1.048, 28.11, 0.54, 5.063, 0.89),
    (390.134508, 0.0045, 7.347, 21.52, 0.63, 4.81, 0.55),
    (437.346667, 0.0632, 5.048, 18.45, 0.6, 4.23, 0.48),
    (439.150807, 0.9098, 3.595, 20.07, 0.63, 4.483, 0.52),
    (443.018343, 0.192, 5.048, 15.55, 0.6, 5.083, 0.5),
    (448.001085, 10.41, 1.405, 25.64, 0.66, 5.028, 0.67),
    (470.888999, 0.3254, 3.597, 21.34, 0.66, 4.506, 0.65),
    (474.689092, 1.26, 2.379, 23.2, 0.65, 4.804, 0.64),
    (488.490108, 0.2529, 2.852, 25.86, 0.69, 5.201, 0.72),
    (503.568532, 0.0372, 6.731, 16.12, 0.61, 3.98, 0.43),
    (504.482692, 0.0124, 6.731, 16.12, 0.61, 4.01, 0.45),
    (547.67644, 0.9785, 0.158, 26.0, 0.7, 4.5, 1.0),
    (552.02096, 0.184, 0.158, 26.0, 0.7, 4.5, 1.0),
    (556.935985, 497.0, 0.159, 30.86, 0.69, 4.552, 1.0),
    (620.700807, 5.015, 2.391, 24.38, 0.71, 4.856, 0.68),
    (645.766085, 0.0067, 8.633, 18.0, 0.6, 4.0, 0.5),
    (658.00528, 0.2732, 7.816, 32.1, 0.69, 4.14, 1.0),
    (752.033113, 243.4, 0.396, 30.86, 0.68, 4.352, 0.84),
    (841.051732, 0.0134, 8.177, 15.9, 0.33, 5.76, 0.45),
    (859.965698, 0.1325, 8.055, 30.6, 0.68, 4.09, 0.84),
    (899.303175, 0.0547, 7.914, 29.85, 0.68, 4.53, 0.9),
    (902.611085, 0.0386, 8.429, 28.65, 0.7, 5.1, 0.95),
    (906.205957, 0.1836, 5.11, 24.08, 0.7, 4.7, 0.53),
    (916.171582, 8.4, 1.441, 26.73, 0.7, 5.15, 0.78),
    (923.112692, 0.0079, 10.293, 29.0, 0.7, 5.0, 0.8),
    (970.315022, 9.009, 1.919, 25.5, 0.64, 4.94, 0.67),
    (987.926764, 134.6, 0.257, 29.85, 0.68, 4.55, 0.9),
    (1780.0, 17506.0, 0.952, 196.3, 2.0, 24.15, 5.0),
)
#: Lines a table may have: it is joined to every point.
MOST_LINES = 10_000


def vapour_pressure(grams_m3: Column, kelvin: Column) -> Column:
    return grams_m3 * kelvin / 216.7


def dry_continuum(ghz: Column, dry_hpa: Column, kelvin: Column, grams_m3: Column) -> Column:
    """dB per km."""
    theta, e = 300 / kelvin, vapour_pressure(grams_m3, kelvin)
    width = 5.6e-4 * (dry_hpa + e) * F.pow(theta, F.lit(0.8))
    debye = 6.14e-5 / (width * (1 + F.pow(ghz / width, F.lit(2.0))))
    nitrogen = 1.4e-12 * dry_hpa * F.pow(theta, F.lit(1.5)) / (1 + 1.9e-5 * F.pow(ghz, F.lit(1.5)))
    return 0.1820 * ghz * ghz * dry_hpa * theta * theta * (debye + nitrogen)


def _functions(x) -> tuple:
    return (F.pow, F.sqrt, F.exp) if isinstance(x, Column) else (np.power, np.sqrt, np.exp)


def oxygen_term(f0, a1, a2, a3, a4, a5, a6, ghz: Column, dry: Column, theta: Column, e: Column) -> Column:
    """What a line of oxygen adds: Zeeman-broadened width, interference between neighbouring lines. Columns, or NumPy arrays."""
    (pw, sqrt, exp), near, far = _functions(ghz), f0 - ghz, f0 + ghz
    plain = a3 * 1e-4 * (dry * pw(theta, 0.8 - a4) + 1.1 * e * theta)
    width = sqrt(plain * plain + 2.25e-6)
    shift = (a5 + a6 * theta) * 1e-4 * (dry + e) * pw(theta, 0.8)
    shape = ghz / f0 * ((width - shift * near) / (near * near + width * width) + (width - shift * far) / (far * far + width * width))
    return a1 * 1e-7 * dry * pw(theta, 3.0) * exp(a2 * (1 - theta)) * shape


def water_term(f0, b1, b2, b3, b4, b5, b6, ghz: Column, dry: Column, theta: Column, e: Column) -> Column:
    """What a line of water adds: width with Doppler broadening. Columns, or NumPy arrays."""
    (pw, sqrt, exp), near, far = _functions(ghz), f0 - ghz, f0 + ghz
    wide = b3 * 1e-4 * (dry * pw(theta, b4) + b5 * e * pw(theta, b6))
    width = 0.535 * wide + sqrt(0.217 * wide * wide + 2.1316e-12 * f0 * f0 / theta)
    shape = ghz / f0 * (width / (near * near + width * width) + width / (far * far + width * width))
    return b1 * 0.1 * e * pw(theta, 3.5) * exp(b2 * (1 - theta)) * shape


def _summed(lines, term: Callable[..., np.ndarray], *air: np.ndarray) -> np.ndarray:
    out = np.zeros(len(air[0]))
    for line in lines:
        out = out + term(*map(float, line), *air)
    return out


def specific(ghz: Column, dry_hpa: Column, kelvin: Column, grams_m3: Column, oxygen=OXYGEN_LINES, water=WATER_LINES) -> Column:
    """Oxygen, water and dry continuum in dB per km, as one expression. The lines are gone through a batch of rows at a time: as a lambda over an
    array of lines the sum is interpreted for each row and line. Rows that lack a value are null and cost nothing."""

    @F.pandas_udf("double")
    def lines(ghz: pd.Series, dry: pd.Series, kelvin: pd.Series, grams: pd.Series) -> pd.Series:
        out = np.full(len(ghz), np.nan)
        f, d, k, g = (np.asarray(x, float) for x in (ghz, dry, kelvin, grams))
        there = ~(np.isnan(f) | np.isnan(d) | np.isnan(k) | np.isnan(g))
        f, d, k, g = f[there], d[there], k[there], g[there]
        with np.errstate(all="ignore"):
            air = f, d, 300 / k, vapour_pressure(g, k)
            out[there] = _summed(oxygen, oxygen_term, *air) + _summed(water, water_term, *air)
        return pd.Series(out)

    return 0.1820 * ghz * lines(ghz, dry_hpa, kelvin, grams_m3) + dry_continuum(ghz, dry_hpa, kelvin, grams_m3)


def absorption(points: DataFrame, oxygen: DataFrame, water: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, oxygen, water, dry, total) in dB per km of points (keys, ghz, dry_hpa, kelvin, grams_m3).

    A line table is a few dozen rows; it is joined to all points and its terms are summed by point. One of more than
    MOST_LINES rows is an error.
    """
    for lines in (oxygen, water):
        if not at_most(lines, MOST_LINES):
            raise ValueError(f"a line table has more than {MOST_LINES} rows")
    p = points.withColumn("theta", 300 / F.col("kelvin")).withColumn("e", vapour_pressure(F.col("grams_m3"), F.col("kelvin")))
    c = F.col
    ghz = c("ghz")
    o_term = oxygen_term(*(c(n) for n in OXYGEN), ghz, c("dry_hpa"), c("theta"), c("e"))
    w_term = water_term(*(c(n) for n in WATER), ghz, c("dry_hpa"), c("theta"), c("e"))
    sums = [p.join(F.broadcast(lines.select(*names))).groupBy(*keys).agg(F.sum(0.1820 * ghz * term).alias(to)) for lines, names, term, to in ((oxygen, OXYGEN, o_term, "oxygen"), (water, WATER, w_term, "water"))]
    out = points.join(sums[0], keys, "left").join(sums[1], keys, "left").fillna(0.0, ["oxygen", "water"])
    out = out.withColumn("dry", dry_continuum(c("ghz"), c("dry_hpa"), c("kelvin"), c("grams_m3")))
    return out.select(*keys, "oxygen", "water", "dry", (c("oxygen") + c("water") + c("dry")).alias("total"))


def rain_path(k_h: Column, a_h: Column, k_v: Column, a_v: Column, elevation: Column, tilt: Column) -> tuple[Column, Column]:
    """Coefficients (k, alpha) for a path's elevation and polarisation tilt, in degrees."""
    g = F.pow(F.cos(F.radians(elevation)), F.lit(2.0)) * F.cos(2 * F.radians(tilt))
    k = (k_h + k_v + (k_h - k_v) * g) / 2
    return k, (k_h * a_h + k_v * a_v + (k_h * a_h - k_v * a_v) * g) / (2 * k)
