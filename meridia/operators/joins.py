"""Joins that Spark has no operator for, as equi-joins on grid cells or windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a grid cell in degrees; about 550 m.
CELL = 0.005
#: The same for segments against small boxes; about 110 m.
SEGMENT_CELL = 0.001
#: The columns of a point's cell.
GRID = ["_gx", "_gy"]
#: Rows that a kernel's results are collected to before they leave its task.
MOST_ROWS = 65_536


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns to as many partitions as shuffles have. For rows that are about to multiply: a small file is one split, and small
    shuffles are joined again, so one task would make all that comes of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def cells_of(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, size: float = CELL) -> Column:
    """Array of structs (gx, gy): the grid cells that a box touches."""
    at = lambda x: F.floor(x / size).cast("long")
    columns = F.sequence(at(min_lon), at(max_lon))
    return F.flatten(F.transform(columns, lambda x: F.transform(F.sequence(at(min_lat), at(max_lat)), lambda y: F.struct(x.alias("gx"), y.alias("gy")))))


def box_join(points: DataFrame, lon: str, lat: str, boxes: DataFrame, bounds: tuple[Column, Column, Column, Column], size: float = CELL, grid: bool = False) -> DataFrame:
    """Points with the boxes that hold them (closed on all sides): boxes are dealt to the cells they touch, points have one
    cell, so a pair meets once. An equi-join: it is planned as a shuffle or, if a side turns out small, a broadcast. Both sides
    are dealt by cell first, so that a table of one small file does not have all of its pairs made by one task; grouping by
    GRID and the point then needs no shuffle of pairs, if ``grid`` keeps these columns."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    b = boxes.withColumns({"_x0": bounds[0], "_y0": bounds[1], "_x1": bounds[2], "_y1": bounds[3]})
    b = b.withColumn("_c", F.explode(cells_of(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), size))).select("*", F.col("_c.gx").alias("_gx"), F.col("_c.gy").alias("_gy")).drop("_c")
    p = points.withColumns({"_gx": at(lon), "_gy": at(lat)})
    inside = F.col(lon).between(F.col("_x0"), F.col("_x1")) & F.col(lat).between(F.col("_y0"), F.col("_y1"))
    out = spread(p, *GRID).join(spread(b, *GRID), GRID).where(inside).drop("_x0", "_y0", "_x1", "_y1")
    return out if grid else out.drop(*GRID)


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def grid_stream(points: DataFrame, others: list[DataFrame], kernel: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """What ``kernel`` yields, a few rows at a time, of the points of a grid cell and of the rows of each other table there (all with GRID),
    as NumPy columns; tables with a ``cell_id`` come in its order. A grid cell's tables meet as one row; its results leave the task as they
    are made and are never held whole, so memory follows the tables and not the pairs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    columns = [[c for c in t.columns if c not in GRID] for t in (points, *others)]
    other = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn("_kind", F.lit(i)) for i, t in enumerate(others)))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    sides = pa.schema([("sides", pa.list_(pa.binary()))])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return sides.empty_table()
        kinds = [right.filter(pc.equal(right["_kind"], i)).select(c) for i, c in enumerate(columns[1:])]
        kinds = [t.sort_by("cell_id") if "cell_id" in t.column_names else t for t in kinds]
        return pa.table([[[_packed(t) for t in (left.select(columns[0]), *kinds)]]], sides)

    def made(row: pa.Scalar) -> Iterator[dict]:
        tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in row]
        return kernel(*({c: np.asarray(t.column(c).to_numpy(zero_copy_only=False)) for c in t.column_names} for t in tables))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for part in (m for batch in batches for row in batch.column(0) for m in made(row)):
            parts.append(pa.table({c: part[c] for c in arrow.names}).cast(arrow))
            n += parts[-1].num_rows
            if n >= MOST_ROWS:
                yield from pa.concat_tables(parts).combine_chunks().to_batches(MOST_ROWS)
                parts, n = [], 0
        if n:
            yield from pa.concat_tables(parts).combine_chunks().to_batches(MOST_ROWS)

    met = spread(points, *GRID).groupBy(*GRID).cogroup(spread(other, *GRID).groupBy(*GRID)).applyInArrow(meet, "sides array<binary>")
    return met.mapInArrow(stream, schema)


def _discs(discs: DataFrame, size: float) -> DataFrame:
    """Discs in each grid cell that they reach into, with the ``scale`` of their longitudes."""
    k = F.cos(F.radians("lat"))
    b = discs.withColumns({"_dx": F.col("radius_m") * 1.01 / (111_320.0 * k), "_dy": F.col("radius_m") * 1.01 / 111_320.0, "scale": k})
    b = b.withColumn("_c", F.explode(cells_of(F.col("lon") - F.col("_dx"), F.col("lat") - F.col("_dy"), F.col("lon") + F.col("_dx"), F.col("lat") + F.col("_dy"), size)))
    return b.select(F.col("_c.gx").alias("_gx"), F.col("_c.gy").alias("_gy"), "scale", *discs.columns)


def _gridded(points: DataFrame, size: float) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    return points.where("lon IS NOT NULL AND lat IS NOT NULL").select(at("lon").alias("_gx"), at("lat").alias("_gy"), *points.columns)


def disc_stream(points: DataFrame, discs: DataFrame, kernel: Callable[[dict, dict], Iterator[dict]], schema: str, size: float = CELL) -> DataFrame:
    """``disc_kernel`` for results as many as pairs: its kernel yields them a few at a time."""
    return grid_stream(_gridded(points, size), [_discs(discs, size)], kernel, schema)


def disc_kernel(points: DataFrame, discs: DataFrame, kernel: Callable[[dict, dict], dict], schema: str, size: float = CELL) -> DataFrame:
    """What ``kernel`` makes of the points (lon, lat) of a grid cell and of all discs (lon, lat, radius_m) that reach into it, both as
    NumPy columns; the discs come in order of ``cell_id``. For sums over pairs: the pairs live in one call only, so neither they nor a
    sort of them is shuffled or written down, and memory follows the points of a grid cell. See ``in_discs`` for the loop over pairs."""
    b, p = _discs(discs, size), _gridded(points, size)
    names = [f.split()[0] for f in schema.split(", ")]

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        here, cells = ({c: np.asarray(t.column(c).to_numpy(zero_copy_only=False)) for c in t.column_names} for t in (left, right.sort_by("cell_id")))
        made = kernel(here, cells) if left.num_rows and right.num_rows else {}
        return pa.table({n: made.get(n, []) for n in names}) if made else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return spread(p, *GRID).groupBy(*GRID).cogroup(spread(b, *GRID).groupBy(*GRID)).applyInArrow(of, schema)


def in_discs(points: dict, cells: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each disc of a call of ``disc_kernel``: its place, the places of the points in it, and their distance, and how far they lie
    east and north of it in degrees of latitude. The same arithmetic as ``geo.distance_m``."""
    lon, lat = points["lon"], points["lat"]
    for j in range(len(cells["lon"])):
        x, y, scale = lon - cells["lon"][j], lat - cells["lat"][j], cells["scale"][j]
        dx, dy = x * 111_320.0 * scale, y * 111_320.0
        d = np.sqrt(dx * dx + dy * dy)
        i = np.flatnonzero(d <= cells["radius_m"][j])
        if len(i):
            yield j, i, d[i], x[i] * scale, y[i]


def within_beam(x: np.ndarray, y: np.ndarray, azimuth: float, width: float) -> np.ndarray:
    """``geo.in_beam`` of ``geo.bearing_deg`` for points of ``in_discs``."""
    bearing = (np.degrees(np.arctan2(x, y)) + 360.0) % 360.0
    return np.abs((bearing - azimuth + 540.0) % 360.0 - 180.0) <= width / 2 if width < 360 else np.ones(len(x), bool)


def held(points: DataFrame, key: str, discs: DataFrame) -> DataFrame:
    """The keys of the points that lie in any disc, each once. A point is not looked at again once a disc holds it, so where discs
    are many the work is near that of the points."""

    def kernel(here: dict, cells: dict) -> dict:
        found, left = [], here
        for j in range(len(cells["lon"])):
            disc = {k: v[j : j + 1] for k, v in cells.items()}
            for _, i, *_ in in_discs(left, disc):
                found.append(left[key][i])
                left = {k: np.delete(v, i) for k, v in left.items()}
            if not len(left[key]):
                break
        return {key: np.concatenate(found)} if found else {}

    return disc_kernel(points.select(key, "lon", "lat"), discs.select("cell_id", "lon", "lat", "radius_m"), kernel, f"{key} long")


def overlap_join(left: DataFrame, left_bounds, right: DataFrame, right_bounds, size: float = CELL) -> DataFrame:
    """Pairs of boxes that overlap (closed): both sides are dealt to cells, and a pair is kept in the cell that holds the
    lower corner of the two boxes' common part only, so no pair is doubled and nothing is deduplicated."""

    def dealt(df: DataFrame, bounds, k: str) -> DataFrame:
        names = dict(zip((f"_{k}x0", f"_{k}y0", f"_{k}x1", f"_{k}y1"), bounds))
        out = df.withColumns(names)
        return out.withColumn("_c", F.explode(cells_of(*(F.col(n) for n in names), size))).select("*", F.col("_c.gx").alias("_gx"), F.col("_c.gy").alias("_gy")).drop("_c")

    both = spread(dealt(left, left_bounds, "l"), *GRID).join(spread(dealt(right, right_bounds, "r"), *GRID), GRID)
    x, y = F.greatest("_lx0", "_rx0"), F.greatest("_ly0", "_ry0")
    here = (F.floor(x / size) == F.col("_gx")) & (F.floor(y / size) == F.col("_gy"))
    meet = (x <= F.least("_lx1", "_rx1")) & (y <= F.least("_ly1", "_ry1"))
    return both.where(here & meet).drop("_gx", "_gy", *(f"_{k}{c}" for k in "lr" for c in ("x0", "y0", "x1", "y1")))


def segment_join(segments: DataFrame, ends: tuple[Column, Column, Column, Column], boxes: DataFrame, bounds, size: float = SEGMENT_CELL) -> DataFrame:
    """Segments (ax, ay, bx, by) with the boxes that they touch (a hair is added, so an exact test may follow), each pair once.

    A segment is dealt to the cells that it passes, column by column, not to those of its box, so a long slanted one meets few
    strangers. A pair is kept in the cell where the segment enters the box. All that is done on pairs is plain arithmetic."""
    at = lambda x: F.floor(x / size).cast("long")
    eps = 1e-9
    s = segments.withColumns(dict(zip(("_ax", "_ay", "_dx", "_dy"), (ends[0], ends[1], ends[2] - ends[0], ends[3] - ends[1]))))
    west, east = F.least(F.col("_ax"), F.col("_ax") + F.col("_dx")), F.greatest(F.col("_ax"), F.col("_ax") + F.col("_dx"))
    south, north = F.least(F.col("_ay"), F.col("_ay") + F.col("_dy")), F.greatest(F.col("_ay"), F.col("_ay") + F.col("_dy"))
    slope = F.when(F.abs("_dx") > eps, F.col("_dy") / F.when(F.abs("_dx") > eps, F.col("_dx")).otherwise(1.0))

    def rows(x: Column) -> Column:
        # the latitudes of the segment inside this column; all of them where it goes straight north
        left, right = F.greatest(west, x * size) - eps, F.least(east, (x + 1) * size) + eps
        y0, y1 = F.col("_ay") + (left - F.col("_ax")) * F.col("_slope"), F.col("_ay") + (right - F.col("_ax")) * F.col("_slope")
        low = F.greatest(F.coalesce(F.least(y0, y1), south), south) - 10 * eps
        high = F.least(F.coalesce(F.greatest(y0, y1), north), north) + 10 * eps
        return F.transform(F.sequence(at(F.least(low, high)), at(F.greatest(low, high))), lambda y: F.struct(x.alias("gx"), y.alias("gy")))

    s = s.withColumn("_slope", slope)
    s = s.withColumn("_c", F.explode(F.flatten(F.transform(F.sequence(at(west - 2 * eps), at(east + 2 * eps)), rows)))).select("*", F.col("_c.gx").alias("_gx"), F.col("_c.gy").alias("_gy")).drop("_c", "_slope")
    names = dict(zip(("_x0", "_y0", "_x1", "_y1"), bounds))
    b = boxes.withColumns(names)
    b = b.withColumn("_c", F.explode(cells_of(F.col("_x0") - 2 * eps, F.col("_y0") - 2 * eps, F.col("_x1") + 2 * eps, F.col("_y1") + 2 * eps, size))).select("*", F.col("_c.gx").alias("_gx"), F.col("_c.gy").alias("_gy")).drop("_c")
    both = spread(s, "_gx", "_gy").join(spread(b, "_gx", "_gy"), ["_gx", "_gy"])

    def span(a: str, d: str, lo: str, hi: str) -> tuple[Column, Column]:
        """When (as shares) a segment is between two lines; an empty span where it never is."""
        moves, by = F.abs(d) > 1e-300, F.when(F.abs(d) > 1e-300, F.col(d)).otherwise(1.0)
        p, q = (F.col(lo) - eps - F.col(a)) / by, (F.col(hi) + eps - F.col(a)) / by
        inside = (F.col(a) >= F.col(lo) - eps) & (F.col(a) <= F.col(hi) + eps)
        return F.when(moves, F.least(p, q)).when(inside, 0.0).otherwise(2.0), F.when(moves, F.greatest(p, q)).when(inside, 1.0).otherwise(-1.0)

    (tx0, tx1), (ty0, ty1) = span("_ax", "_dx", "_x0", "_x1"), span("_ay", "_dy", "_y0", "_y1")
    enters, leaves = F.greatest(F.lit(0.0), tx0, ty0), F.least(F.lit(1.0), tx1, ty1)
    here = (at(F.col("_ax") + enters * F.col("_dx")) == F.col("_gx")) & (at(F.col("_ay") + enters * F.col("_dy")) == F.col("_gy"))
    return both.where((enters <= leaves) & here).drop("_gx", "_gy", "_ax", "_ay", "_dx", "_dy", *names)


def carried(df: DataFrame, keys: list[str], order: list, column: str, to: str) -> DataFrame:
    """The last value seen that is not null, per key in order (last observation carried forward)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(to, F.last(column, ignorenulls=True).over(w))


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str, eps: float = 1e-9) -> DataFrame:
    """The union of intervals per key: (keys, start, end), touching ones joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_new", F.when(F.max(end).over(before) + eps >= F.col(start), 0).otherwise(1))
    named = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return named.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def top_rows(df: DataFrame, keys: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    out = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank or "_rank") <= n)
    return out if rank else out.drop("_rank")
