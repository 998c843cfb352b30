"""Planar and spherical geometry as column expressions. Degrees in, metres and degrees out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree (two scales are in use) and the earth's radius.
DEGREE_M = 111_320.0
DEGREE_LAT_M = 110_540.0
EARTH_M = 6_371_000.0


def distance_m(lon_a, lat_a, lon_b, lat_b) -> Column:
    """Planar distance; the scale of longitudes is that of a's latitude, so the order of the points matters."""
    dx = (lon_b - lon_a) * DEGREE_M * F.cos(F.radians(lat_a))
    dy = (lat_b - lat_a) * DEGREE_M
    return F.sqrt(dx * dx + dy * dy)


def bearing_deg(lon_a, lat_a, lon_b, lat_b) -> Column:
    return F.pmod(F.degrees(F.atan2((lon_b - lon_a) * F.cos(F.radians(lat_a)), lat_b - lat_a)) + 360.0, F.lit(360.0))


def destination(lon, lat, bearing, metres) -> tuple[Column, Column]:
    """The point at a distance on the sphere: (lon, lat)."""
    d, b, p = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return normal_longitude(lon + F.degrees(turn)), F.degrees(to)


def normal_longitude(lon) -> Column:
    return F.pmod(lon + 540.0, F.lit(360.0)) - 180.0


def turn_deg(a, b) -> Column:
    """The signed smallest turn from b to a, in [-180, 180)."""
    return F.pmod(a - b + 540.0, F.lit(360.0)) - 180.0


def in_beam(angle, azimuth, width) -> Column:
    return (width >= 360) | (F.abs(turn_deg(angle, azimuth)) <= width / 2)


def ray_angle(azimuth, width, rays, index) -> Column:
    """Rays start at the beam's edge; the other edge is not among them."""
    return F.pmod(azimuth - width / 2 + index * width / rays + 360.0, F.lit(360.0))


def edges(ring: Column) -> Column:
    """Edges of an open ring of structs (lon, lat): structs (ax, ay, bx, by), the last one closing it."""
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, ahead, lambda a, b: F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by")))


def in_polygon(lon, lat, ring: Column) -> Column:
    """Even-odd rule, half-open in latitude; points on the boundary may fall on either side."""

    def crosses(e: Column) -> Column:
        return ((e["ay"] > lat) != (e["by"] > lat)) & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def on_segment(lon, lat, e: Column, eps: float = 1e-10) -> Column:
    cross = (e["bx"] - e["ax"]) * (lat - e["ay"]) - (e["by"] - e["ay"]) * (lon - e["ax"])
    within = lon.between(F.least(e["ax"], e["bx"]) - eps, F.greatest(e["ax"], e["bx"]) + eps) & lat.between(F.least(e["ay"], e["by"]) - eps, F.greatest(e["ay"], e["by"]) + eps)
    return (F.abs(cross) <= eps) & within


def in_or_on_polygon(lon, lat, ring: Column) -> Column:
    """Like in_polygon, but a point on the boundary is inside (the rule of hand-drawn selections)."""
    return F.exists(edges(ring), lambda e: on_segment(lon, lat, e)) | in_polygon(lon, lat, ring)


def crossing(ax, ay, bx, by, e: Column) -> Column:
    """Where along a -> b (0 to 1) the segment meets an edge; null if parallel or apart."""
    den = (bx - ax) * (e["by"] - e["ay"]) - (by - ay) * (e["bx"] - e["ax"])
    t = ((e["ax"] - ax) * (e["by"] - e["ay"]) - (e["ay"] - ay) * (e["bx"] - e["ax"])) / F.nullif(den, F.lit(0.0))
    u = ((e["ax"] - ax) * (by - ay) - (e["ay"] - ay) * (bx - ax)) / F.nullif(den, F.lit(0.0))
    return F.when((F.abs(den) >= 1e-14) & t.between(0, 1) & u.between(0, 1), t)


def crossings(ax, ay, bx, by, ring: Column, apart: float = 0.0) -> Column:
    """Ascending places where a segment meets a ring; of places closer than ``apart`` to one kept before, none is kept.
    Rings of four are unrolled: lambdas are interpreted, plain arithmetic is compiled."""
    found = F.array_sort(F.filter(F.transform(edges(ring), lambda e: crossing(ax, ay, bx, by, e)), lambda t: t.isNotNull()))
    empty = F.array().cast("array<double>")
    each = F.aggregate(found, empty, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) > apart), F.concat(kept, F.array(t))).otherwise(kept))
    return each if apart else F.when(F.size(ring) == 4, _crossings_of_four(ax, ay, bx, by, ring)).otherwise(each)


def _crossings_of_four(ax, ay, bx, by, ring: Column) -> Column:
    at = lambda i: F.get(ring, F.lit(i % 4))
    sides = ({"ax": at(i)["lon"], "ay": at(i)["lat"], "bx": at(i + 1)["lon"], "by": at(i + 1)["lat"]} for i in range(4))
    found = F.sort_array(F.array(*(crossing(ax, ay, bx, by, e) for e in sides)))
    return F.array_except(found, F.array(F.lit(None).cast("double")))  # keeps the order; drops nulls and repeats


def centroid(ring: Column) -> Column:
    """Struct (lon, lat): the area's centre, taken from the first vertex; the mean of the vertices where the area is nil."""
    o = F.element_at(ring, 1)
    parts = F.transform(edges(ring), lambda e: F.struct(((e["ax"] - o["lon"]) * (e["by"] - o["lat"]) - (e["bx"] - o["lon"]) * (e["ay"] - o["lat"])).alias("c"), (e["ax"] + e["bx"] - 2 * o["lon"]).alias("x"), (e["ay"] + e["by"] - 2 * o["lat"]).alias("y")))
    total = lambda f: F.aggregate(F.transform(parts, f), F.lit(0.0), lambda a, b: a + b)
    area = total(lambda p: p["c"])
    mean = lambda f: F.aggregate(F.transform(ring, f), F.lit(0.0), lambda a, b: a + b) / F.size(ring)
    flat = F.abs(area / 2) < 1e-14
    lon = F.when(flat, mean(lambda v: v["lon"])).otherwise(o["lon"] + total(lambda p: p["x"] * p["c"]) / (3 * F.nullif(area, F.lit(0.0))))
    lat = F.when(flat, mean(lambda v: v["lat"])).otherwise(o["lat"] + total(lambda p: p["y"] * p["c"]) / (3 * F.nullif(area, F.lit(0.0))))
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def perimeter_points(ring: Column) -> Column:
    """Vertices, edge midpoints and the centroid."""
    mid = F.transform(edges(ring), lambda e: F.struct(((e["ax"] + e["bx"]) / 2).alias("lon"), ((e["ay"] + e["by"]) / 2).alias("lat")))
    return F.concat(ring, mid, F.array(centroid(ring)))


def to_segment_m(lon, lat, ax, ay, bx, by) -> Column:
    """Metres from a point to a segment."""
    k = DEGREE_M * F.cos(F.radians(lat))
    px, py, qx, qy = (ax - lon) * k, (ay - lat) * DEGREE_M, (bx - lon) * k, (by - lat) * DEGREE_M
    dx, dy = qx - px, qy - py
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(px * dx + py * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    return F.sqrt(F.pow(px + t * dx, 2) + F.pow(py + t * dy, 2))


def bounds_around(lon, lat, metres) -> tuple[Column, Column, Column, Column]:
    """(min_lon, min_lat, max_lon, max_lat) of a disc."""
    dx, dy = metres / (DEGREE_M * F.cos(F.radians(lat))), metres / DEGREE_M
    return lon - dx, lat - dy, lon + dx, lat + dy


def quadkey_tile(quadkey: Column) -> Column:
    """Struct (x, y, zoom) of a Web-Mercator quadkey."""
    digits = F.filter(F.split(quadkey, ""), lambda d: d != "")
    fold = lambda bit: F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 2 + bit(d.cast("int")))
    return F.struct(fold(lambda d: d.bitwiseAND(1)).alias("x"), fold(lambda d: F.shiftright(d, 1)).alias("y"), F.length(quadkey).alias("zoom"))


def tile_bounds(x, y, zoom) -> tuple[Column, Column, Column, Column]:
    n = F.pow(F.lit(2.0), zoom)
    lat = lambda row: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def reaches_polygon(lon, lat, metres, ring: Column, slack: float = 0.01) -> Column:
    """Whether a disc touches a polygon: its centre is inside, or an edge is no farther than the radius and a little."""
    return in_polygon(lon, lat, ring) | F.exists(edges(ring), lambda e: to_segment_m(lon, lat, e["ax"], e["ay"], e["bx"], e["by"]) <= metres + slack)


def meets_box(ring: Column, min_lon, min_lat, max_lon, max_lat) -> Column:
    """Whether a polygon and a box share a point: a vertex in the box, a corner in the polygon, or edges that cross."""
    corners = ((min_lon, min_lat), (max_lon, min_lat), (max_lon, max_lat), (min_lon, max_lat))
    vertex = F.exists(ring, lambda v: v["lon"].between(min_lon, max_lon) & v["lat"].between(min_lat, max_lat))
    corner = in_polygon(*corners[0], ring) | in_polygon(*corners[1], ring) | in_polygon(*corners[2], ring) | in_polygon(*corners[3], ring)
    sides = [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
    crossed = F.exists(edges(ring), lambda e: F.coalesce(*(crossing(*s, e) for s in sides)).isNotNull())
    return vertex | corner | crossed
