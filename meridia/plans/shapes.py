"""Geometry that is put right or cut to a box, and rasters that are written in blocks and read back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from meridia.functions import mending
from meridia.functions.numeric import rounded, rounded_sql
from meridia.operators.joins import spread
from meridia.operators.tables import new_folder, shared_table
from meridia.plans import lens
from meridia.plans.registry import query
from meridia.sources import raster

#: Square metres of a square degree, as footprints are drawn.
_M2 = 111320.0 * 111320.0
_BOX = (32.87, 39.97, 32.93, 40.03)


def _drawn(spark, sf_dir):
    """Footprints drawn in six ways: plain, as a bow-tie, with a courtyard, with one that sticks out, with repeated corners, and flat."""
    b = lens.buildings(spark, sf_dir).select("building_id", "lon", "lat", "half")
    at = lambda x, y: F.struct((F.col("lon") + x * F.col("half")).alias("lon"), (F.col("lat") + y * F.col("half")).alias("lat"))
    ring = lambda *p: F.array(*(at(x, y) for x, y in p))
    square = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    ways = (
        F.array(ring(*square)), F.array(ring((-1, -1), (1, 1), (1, -1), (-1, 1))), F.array(ring(*square), ring((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))), F.array(ring(*square), ring((0.5, -0.5), (1.5, -0.5), (1.5, 0.5), (0.5, 0.5))),
        F.array(ring((-1, -1), *square, (-1, -1))), F.array(ring((-1, -1), (0, 0), (1, 1))),
    )
    way = F.col("building_id") % len(ways)
    rings = F.coalesce(*(F.when(way == i, r) for i, r in enumerate(ways)))
    return b.withColumn("way", way).withColumn("rings", rings)


@query("mended_footprints", f"WITH {lens.BUILDINGS}, w AS (SELECT *, building_id % 6 AS way FROM lens_buildings) SELECT building_id, ['valid', 'repaired_geometry', 'valid', 'repaired_geometry', 'valid', 'invalid_geometry'][way + 1] AS status, way IN (1, 3) AS crossing, [1, 2, 1, 2, 1, 0][way + 1]::INTEGER AS n_polygons, [1, 2, 2, 2, 1, 0][way + 1]::INTEGER AS n_rings, {rounded_sql(f'[4.0, 2.0, 3.0, 4.0, 4.0, 0.0][way + 1]::DOUBLE * half * half * {_M2}', 2)} AS area_m2 FROM w")
def mended_footprints(spark, sf_dir):
    """Footprints put right: what was wrong, and how many polygons, rings and square metres there are then."""
    m = spread(_drawn(spark, sf_dir), "building_id").withColumn("m", mending.mended("rings"))  # a small file is one split, mending is slow
    area = mending.polygons_area(F.col("m.polygons"), F.col("lon"), F.col("lat"))
    return m.select("building_id", F.substring_index("m.status", ":", 1).alias("status"), F.contains("m.status", F.lit("Self-intersection")).alias("crossing"), F.size("m.polygons").alias("n_polygons"), F.size(F.flatten("m.polygons")).alias("n_rings"), rounded(area * _M2, 2).alias("area_m2"))


def _inside_sql(reach: str) -> str:
    w, s, e, n = _BOX
    return f"greatest(least(lon + {reach}, {e}) - greatest(lon - {reach}, {w}), 0.0::DOUBLE) * greatest(least(lat + {reach}, {n}) - greatest(lat - {reach}, {s}), 0.0::DOUBLE)"


@query("clipped_footprints", f"WITH {lens.BUILDINGS}, a AS (SELECT building_id, {_inside_sql('half')} - CASE WHEN building_id % 6 = 2 THEN {_inside_sql('half / 2')} ELSE 0.0 END AS area FROM lens_buildings WHERE building_id % 6 IN (0, 2, 4)) SELECT building_id, {rounded_sql(f'area * {_M2}', 2)} AS area_m2 FROM a WHERE area * {_M2} > 0.01")
def clipped_footprints(spark, sf_dir):
    """Footprints, courtyards and all, cut to a box: the square metres that are left. A cheap test of the outer box comes first."""
    w, s, e, n = _BOX
    b = _drawn(spark, sf_dir).where("way IN (0, 2, 4)").where((F.col("lon") + F.col("half") > w) & (F.col("lon") - F.col("half") < e) & (F.col("lat") + F.col("half") > s) & (F.col("lat") - F.col("half") < n))
    area = mending.polygons_area(mending.clipped(F.col("rings"), _BOX), F.col("lon"), F.col("lat")) * _M2
    return b.withColumn("area", area).where("area > 0.01").select("building_id", rounded(F.col("area"), 2).alias("area_m2"))


_PIXEL, _SIDE = 0.001, 50
_PIXELS = f"""WITH {lens.SAMPLES}, p AS (SELECT floor((lat - {lens.SOUTH}) / {_PIXEL})::BIGINT AS y, floor((lon - {lens.WEST}) / {_PIXEL})::BIGINT AS x, max(floor(rsrp))::DOUBLE AS z FROM lens_samples GROUP BY 1, 2)"""


@query("raster_blocks", f"{_PIXELS} SELECT (x // {_SIDE}) || '-' || (y // {_SIDE}) AS tile, ({_SIDE - 1} - y % {_SIDE})::INTEGER AS row, (x % {_SIDE})::INTEGER AS col, {rounded_sql(f'{lens.WEST} + (x + 0.5) * {_PIXEL}', 6)} AS lon, {rounded_sql(f'{lens.SOUTH} + (y + 0.5) * {_PIXEL}', 6)} AS lat, z FROM p")
def raster_blocks(spark, sf_dir):
    """Strongest levels as GeoTIFF files (strips or tiles, plain or compressed, differenced or not, by tile) and back: each block of a
    file is a row that any task may decode."""
    s = lens.samples(spark, sf_dir).select(F.floor((F.col("lat") - lens.SOUTH) / _PIXEL).alias("y"), F.floor((F.col("lon") - lens.WEST) / _PIXEL).alias("x"), F.floor("rsrp").cast("double").alias("z"))
    p = s.groupBy("y", "x").agg(F.max("z").alias("z")).select(F.floor(F.col("x") / _SIDE).alias("tx"), F.floor(F.col("y") / _SIDE).alias("ty"), F.pmod("x", F.lit(_SIDE)).alias("col"), (_SIDE - 1 - F.pmod("y", F.lit(_SIDE))).alias("row"), "z")
    folder = new_folder(spark, "rasters")

    def write(key, pixels: pd.DataFrame) -> pd.DataFrame:
        x, y = int(key[0]), int(key[1])
        grid = np.full((_SIDE, _SIDE), np.nan)
        grid[pixels["row"], pixels["col"]] = pixels["z"]
        block, deflate = ((16, 32) if x % 2 else None), y % 2 == 1
        raw = raster.write_geotiff(grid, lens.WEST + x * _SIDE * _PIXEL, lens.SOUTH + (y + 1) * _SIDE * _PIXEL, _PIXEL, _PIXEL, -32768, "i2" if (x + y) % 3 else "f4", block, deflate, 2 if (x + y) % 3 == 2 else 1)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{x}-{y}.{uuid.uuid4().hex}.tif"  # a task that runs again writes another file
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(raw)
        return pd.DataFrame({"path": [f"{folder}/{name}"]})

    written = shared_table(p.groupBy("tx", "ty").applyInPandas(write, "path string"), "written")
    found = raster.geotiff_of(written).where("z IS NOT NULL")
    return found.select(F.substring_index("tile", ".", 1).alias("tile"), "row", "col", rounded(F.col("lon"), 6).alias("lon"), rounded(F.col("lat"), 6).alias("lat"), "z")
