"""Rounding and ratios as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 0) -> Column:
    """Half away from zero, by scaling: the same in every engine, unlike round() on decimal strings."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def rounded_sql(x: str, digits: int = 0) -> str:
    scale = float(10**digits)
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale})"


def rounded_array(x: np.ndarray, digits: int = 0) -> np.ndarray:
    """``rounded`` of an array."""
    scale = float(10**digits)
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def ratio01(part: Column, whole: Column) -> Column:
    """part / whole held in [0, 1]; 0 where there is no whole."""
    return F.when(whole > 0, clamp01(part / whole)).otherwise(0.0)
