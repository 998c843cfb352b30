"""Overlap of polygons and facade entry points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions import geo

LATTICE = 64


def _area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2) if len(p) > 2 else 0.0


def _convex(p: np.ndarray) -> bool:
    a = np.roll(p, -1, axis=0) - p
    b = np.roll(a, -1, axis=0)
    turn = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    return len(p) > 2 and bool((turn >= -1e-18).all() or (turn <= 1e-18).all())


def _clipped(p: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of p inside convex ``by``: one half-plane after the other."""
    by = by if _area(by) > 0 else by[::-1]
    for a, b in zip(by, np.roll(by, -1, axis=0)):
        if len(p) == 0:
            break
        side = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
        out = []
        for i in range(len(p)):
            j = (i + 1) % len(p)
            if side[i] >= 0:
                out.append(p[i])
            if (side[i] >= 0) != (side[j] >= 0):
                out.append(p[i] + (p[j] - p[i]) * side[i] / (side[i] - side[j]))
        p = np.array(out).reshape(-1, 2)
    return p


def _inside(points: np.ndarray, p: np.ndarray) -> np.ndarray:
    odd = np.zeros(len(points), bool)
    for a, b in zip(p, np.roll(p, -1, axis=0)):
        crossing = (a[1] > points[:, 1]) != (b[1] > points[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= crossing & (points[:, 0] < (b[0] - a[0]) * (points[:, 1] - a[1]) / (b[1] - a[1]) + a[0])
    return odd


def iou(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union: by clipping if both are convex, else counted on a lattice over the common box."""
    if len(a) < 3 or len(b) < 3:
        return 0.0
    o = a[0].copy()
    a, b = a - o, b - o
    if _convex(a) and _convex(b):
        both = abs(_area(_clipped(a, b)))
        whole = abs(_area(a)) + abs(_area(b)) - both
        return both / whole if whole > 0 else 0.0
    low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    if (high <= low).any():
        return 0.0
    step = (np.arange(LATTICE) + 0.5) / LATTICE
    x, y = np.meshgrid(low[0] + step * (high[0] - low[0]), low[1] + step * (high[1] - low[1]))
    points = np.stack([x.ravel(), y.ravel()], 1)
    in_a, in_b = _inside(points, a), _inside(points, b)
    return float((in_a & in_b).sum() / max(1, (in_a | in_b).sum()))


def _points(ring) -> np.ndarray:
    return np.array([(v["lon"], v["lat"]) for v in (ring if ring is not None else [])], float).reshape(-1, 2)


@F.pandas_udf(T.DoubleType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """iou of two columns of rings (arrays of structs lon, lat)."""
    return pd.Series([iou(_points(x), _points(y)) for x, y in zip(a, b)], dtype=float)


def facade_share(ax: Column, ay: Column, bx: Column, by: Column, ring: Column, metres: Column, beside_m: float = 0.2) -> Column:
    """Where along a -> b (0 to 1) the path first enters the ring from outside; null if a is inside or b outside."""
    at = lambda t: (ax + (bx - ax) * t, ay + (by - ay) * t)
    d = beside_m / metres
    enters = F.filter(geo.crossings(ax, ay, bx, by, ring), lambda t: ~geo.in_polygon(*at(F.greatest(t - d, F.lit(0.0))), ring) & geo.in_polygon(*at(F.least(t + d, F.lit(1.0))), ring))
    return F.when((metres > 0) & ~geo.in_polygon(ax, ay, ring) & geo.in_polygon(bx, by, ring), F.try_element_at(enters, F.lit(1)))
