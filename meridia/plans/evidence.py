"""Height evidence, terrain sampling, clearance, zonal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geo, tags
from meridia.functions.numeric import rounded, rounded_sql
from meridia.operators.joins import box_join, top_rows
from meridia.operators.ordered import followed
from meridia.plans import lens
from meridia.plans.buildings import _TALL
from meridia.plans.registry import query

PIXEL, COLUMNS = 0.004, 50
#: Precedence of height sources, best first.
PRECEDENCE = ("user", "lidar", "osm_explicit", "external_matched", "external", "osm_levels", "dsm_minus_dtm", "fallback")
CONFLICT_M, CONFLICT_SHARE, UNCERTAIN_BASE_M = 5.0, 0.25, 5.0


def raster(spark, sf_dir) -> DataFrame:
    """(row, col, z): a terrain raster; z is null where there is no data."""
    k = F.col("p_partkey")
    z = F.when(k % 41 != 0, 800.0 + (k * 37 % 200) / 10.0)
    return lens.table(spark, sf_dir, "part").select(F.floor(k / COLUMNS).alias("row"), (k % COLUMNS).alias("col"), z.alias("z"))


RASTER = f"lens_raster AS (SELECT p_partkey // {COLUMNS} AS row, p_partkey % {COLUMNS} AS col, CASE WHEN p_partkey % 41 <> 0 THEN 800.0::DOUBLE + (p_partkey * 37 % 200) / 10.0::DOUBLE END AS z FROM part)"


def bilinear(points: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, lon, lat) with ``z``: the mean of the four pixels around, weighted by nearness; null if any is missing.

    A point asks for its four pixels in one equi-join and one aggregation, whatever the size of the raster.
    """
    x, y = (F.col("lon") - lens.WEST) / PIXEL - 0.5, (F.col("lat") - lens.SOUTH) / PIXEL - 0.5
    p = points.withColumn("_x", x).withColumn("_y", y)
    fx, fy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    corner = lambda dr, dc, w: F.struct((F.floor("_y") + dr).alias("row"), (F.floor("_x") + dc).alias("col"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(0, 1, fx * (1 - fy)), corner(1, 0, (1 - fx) * fy), corner(1, 1, fx * fy))
    asked = p.withColumn("_c", F.explode(four)).select(*points.columns, "_c.row", "_c.col", "_c.w")
    got = asked.join(pixels, ["row", "col"], "left").groupBy(*keys).agg(F.count("z").alias("_n"), F.sum(F.col("w") * F.col("z")).alias("_z"))
    return got.select(*keys, F.when(F.col("_n") == 4, F.col("_z")).alias("z"))


_BILINEAR = f"""(SELECT id, CASE WHEN count(z) = 4 THEN sum(w * z) END AS z FROM (SELECT id, floor(y)::BIGINT + dr AS row, floor(x)::BIGINT + dc AS col, CASE WHEN dc = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN dr = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END AS w
 FROM (SELECT id, (lon - {lens.WEST}) / {PIXEL} - 0.5 AS x, (lat - {lens.SOUTH}) / {PIXEL} - 0.5 AS y FROM POINTS), range(2) r(dr), range(2) c(dc)) LEFT JOIN lens_raster USING (row, col) GROUP BY id)"""


@query("terrain_sample", f"WITH {lens.SAMPLES}, {RASTER}, pt AS (SELECT sample_id AS id, lon, lat FROM lens_samples) SELECT id AS sample_id, {rounded_sql('z', 4)} AS elevation_m, CASE WHEN z IS NULL THEN 'no_data' ELSE 'interpolated' END AS status FROM {_BILINEAR.replace('POINTS', 'pt')}")
def terrain_sample(spark, sf_dir):
    z = bilinear(lens.samples(spark, sf_dir).select("sample_id", "lon", "lat"), raster(spark, sf_dir), ["sample_id"])
    return z.select("sample_id", rounded(F.col("z"), 4).alias("elevation_m"), F.when(F.col("z").isNull(), "no_data").otherwise("interpolated").alias("status"))


@query("building_base", f"""WITH {lens.BUILDINGS}, {RASTER}, v AS (SELECT building_id, unnest([{{'x': lon - half, 'y': lat - half}}, {{'x': lon + half, 'y': lat - half}}, {{'x': lon + half, 'y': lat + half}}, {{'x': lon - half, 'y': lat + half}}, {{'x': lon, 'y': lat - half}}, {{'x': lon + half, 'y': lat}}, {{'x': lon, 'y': lat + half}}, {{'x': lon - half, 'y': lat}}, {{'x': lon, 'y': lat}}]) AS p FROM lens_buildings),
 pt AS (SELECT row_number() OVER () AS id, building_id, p.x AS lon, p.y AS lat FROM v), z AS (SELECT building_id, z FROM pt JOIN {_BILINEAR.replace('POINTS', 'pt')} USING (id))
 SELECT building_id, count(z)::BIGINT AS n, {rounded_sql('min(z)', 3)} AS least, {rounded_sql('median(z)', 3)} AS median, {rounded_sql('max(z) - min(z)', 3)} AS spread, coalesce(max(z) - min(z) > {UNCERTAIN_BASE_M}, false) AS uncertain FROM z GROUP BY building_id""")
def building_base(spark, sf_dir):
    """Ground height of a building from its vertices, edge midpoints and centre."""
    p = lens.buildings(spark, sf_dir).select("building_id", F.posexplode(geo.perimeter_points(F.col("ring"))).alias("i", "p")).select("building_id", "i", "p.lon", "p.lat")
    z = bilinear(p, raster(spark, sf_dir), ["building_id", "i"])
    spread = F.max("z") - F.min("z")
    return z.groupBy("building_id").agg(F.count("z").alias("n"), rounded(F.min("z"), 3).alias("least"), rounded(F.median("z"), 3).alias("median"), rounded(spread, 3).alias("spread"), F.coalesce(spread > UNCERTAIN_BASE_M, F.lit(False)).alias("uncertain"))


@query("zonal_statistics", f"""WITH {lens.CELLS}, {RASTER}, j AS (SELECT c.cell_id, z FROM lens_cells c JOIN lens_raster r ON sqrt(pow(({lens.WEST} + (col + 0.5) * {PIXEL} - c.lon) * 111320.0 * cos(radians(c.lat)), 2) + pow(({lens.SOUTH} + (row + 0.5) * {PIXEL} - c.lat) * 111320.0, 2)) <= c.radius_m)
 SELECT cell_id, count(*)::BIGINT AS pixels, count(*) FILTER (z IS NULL)::BIGINT AS no_data, {rounded_sql('avg(z)', 3)} AS mean, {rounded_sql('quantile_cont(z, 0.9)', 3)} AS p90, CASE WHEN count(z) >= 4 THEN 'robust' WHEN count(z) > 0 THEN 'sparse' ELSE 'unsupported' END AS support FROM j GROUP BY cell_id""")
def zonal_statistics(spark, sf_dir):
    """Pixels whose centre lies in a cell's disc."""
    px = raster(spark, sf_dir).select("z", (lens.WEST + (F.col("col") + 0.5) * PIXEL).alias("lon"), (lens.SOUTH + (F.col("row") + 0.5) * PIXEL).alias("lat"))
    c = lens.cells(spark, sf_dir).select("cell_id", "radius_m", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    j = box_join(px, "lon", "lat", c, geo.bounds_around(F.col("c_lon"), F.col("c_lat"), F.col("radius_m") * 1.01)).where(geo.distance_m(F.col("c_lon"), F.col("c_lat"), F.col("lon"), F.col("lat")) <= F.col("radius_m"))
    support = F.when(F.count("z") >= 4, "robust").when(F.count("z") > 0, "sparse").otherwise("unsupported")
    return j.groupBy("cell_id").agg(F.count("*").alias("pixels"), F.count_if(F.col("z").isNull()).alias("no_data"), rounded(F.avg("z"), 3).alias("mean"), rounded(F.expr("percentile(z, 0.9)"), 3).alias("p90"), support.alias("support"))


def clearance_class(least: Column, margin: float = 0.0) -> Column:
    if margin == 0:
        return F.when(least < 0, "obstruction_candidate").otherwise("clear")
    return F.when(least < -margin, "obstruction_candidate").when(F.abs(least) <= margin, "near_uncertainty").otherwise("clear")


STEPS, MAST_M = 20, 25.0


@query("terrain_clearance", f"""WITH {lens.CELLS}, {RASTER}, l AS (SELECT cell_id, lon AS ax, lat AS ay, lead(lon) OVER (ORDER BY cell_id) AS qx, lead(lat) OVER (ORDER BY cell_id) AS qy, ghz FROM lens_cells), s AS (SELECT cell_id * {STEPS + 1} + i AS id, cell_id, ghz, i / {float(STEPS)}::DOUBLE AS t, ax + (qx - ax) * i / {float(STEPS)}::DOUBLE AS lon, ay + (qy - ay) * i / {float(STEPS)}::DOUBLE AS lat,
  sqrt(pow((qx - ax) * 111320.0 * cos(radians(ay)), 2) + pow((qy - ay) * 111320.0, 2)) AS d FROM l, range({STEPS + 1}) r(i) WHERE qx IS NOT NULL), z AS (SELECT s.*, z FROM s JOIN {_BILINEAR.replace('POINTS', 's')} USING (id)),
 e AS (SELECT *, max(z) FILTER (t = 0) OVER w AS z0, max(z) FILTER (t = 1) OVER w AS z1 FROM z WINDOW w AS (PARTITION BY cell_id)), c AS (SELECT cell_id, t, {rounded_sql(f'(z0 + {MAST_M} + (z1 - z0) * t - z)', 6)} AS clear, sqrt(0.299792458 / ghz * t * (1 - t) * d) AS fresnel FROM e)
 SELECT cell_id, count(clear)::BIGINT AS n, {rounded_sql('min(clear)', 4)} AS least, {rounded_sql('arg_min(t, (clear, t)) FILTER (clear IS NOT NULL)', 4)} AS at_share, {rounded_sql('max(fresnel)', 4)} AS fresnel_m, CASE WHEN count(clear) < count(*) THEN 'unavailable' WHEN min(clear) < -2 THEN 'obstruction_candidate' WHEN abs(min(clear)) <= 2 THEN 'near_uncertainty' ELSE 'clear' END AS class FROM c GROUP BY cell_id""")
def terrain_clearance(spark, sf_dir):
    """The line between masts of cells that follow each other by id, over the terrain below it; margin 2 m. Clearances are whole
    micrometres, so that places with the same one are ties, whatever order their pixels were added in; the first of them counts."""
    l = followed(lens.cells(spark, sf_dir).select("cell_id", "ghz", "lon", "lat"), ["cell_id"], ["lon", "lat"]).where("next IS NOT NULL")
    l = l.select("cell_id", "ghz", F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.col("next.lon").alias("bx"), F.col("next.lat").alias("by"))
    s = l.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    part = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / float(STEPS)
    p = s.select("cell_id", "i", part("ax", "bx").alias("lon"), part("ay", "by").alias("lat"))
    z = bilinear(p, raster(spark, sf_dir), ["cell_id", "i"])
    d = l.select("cell_id", "ghz", geo.distance_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("d"))
    one = Window.partitionBy("cell_id")
    end = lambda k: F.max(F.when(F.col("i") == k, F.col("z"))).over(one)
    z = z.withColumn("z0", end(0)).withColumn("z1", end(STEPS)).withColumn("t", F.col("i") / float(STEPS)).join(d, "cell_id")
    c = z.withColumn("clear", rounded(F.col("z0") + MAST_M + (F.col("z1") - F.col("z0")) * F.col("t") - F.col("z"), 6)).withColumn("fresnel", F.sqrt(0.299792458 / F.col("ghz") * F.col("t") * (1 - F.col("t")) * F.col("d")))
    least = F.min("clear")
    return c.groupBy("cell_id").agg(F.count("clear").alias("n"), rounded(least, 4).alias("least"), rounded(F.min_by("t", F.when(F.col("clear").isNotNull(), F.struct("clear", "t"))), 4).alias("at_share"), rounded(F.max("fresnel"), 4).alias("fresnel_m"), F.when(F.count("clear") < F.count("*"), "unavailable").otherwise(clearance_class(least, 2.0)).alias("class"))


@query("height_precedence", f"""WITH {lens.BUILDINGS}, {_TALL}, c AS (SELECT building_id, height_m AS h, CASE evidence WHEN 'observed_tag' THEN 2 WHEN 'derived_from_levels' THEN 5 ELSE 7 END AS rank FROM tall UNION ALL SELECT building_id, 5.0 + building_id % 60, CASE WHEN building_id % 2 = 0 THEN 3 ELSE 4 END FROM tall WHERE building_id % 5 <> 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY rank, h) AS k, max(h) OVER (PARTITION BY building_id) - min(h) OVER (PARTITION BY building_id) AS diff, count(*) OVER (PARTITION BY building_id) AS n FROM c)
 SELECT building_id, {rounded_sql('h', 3)} AS height_m, [{', '.join(map(repr, PRECEDENCE))}][rank + 1] AS source, n::BIGINT AS candidates, diff > greatest({CONFLICT_M}, {CONFLICT_SHARE} * h) AS review FROM r WHERE k = 1""")
def height_precedence(spark, sf_dir):
    """The best-ranked height of each building, and whether the candidates disagree too much."""
    b = lens.buildings(spark, sf_dir).withColumn("h", tags.height(F.col("height_tag"), F.col("levels_tag")))
    own = b.select("building_id", F.col("h.height_m").alias("h"), F.when(F.col("h.evidence") == "observed_tag", "osm_explicit").when(F.col("h.evidence") == "derived_from_levels", "osm_levels").otherwise("fallback").alias("source"))
    k = F.col("building_id")
    external = b.where(k % 5 != 0).select("building_id", (5.0 + k % 60).alias("h"), F.when(k % 2 == 0, "external_matched").otherwise("external").alias("source"))
    every = own.unionByName(external).withColumn("rank", F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("source")))
    one = Window.partitionBy("building_id")
    every = every.withColumn("diff", F.max("h").over(one) - F.min("h").over(one)).withColumn("candidates", F.count("*").over(one))
    best = top_rows(every, ["building_id"], ["rank", "h"])
    return best.select("building_id", rounded(F.col("h"), 3).alias("height_m"), "source", "candidates", (F.col("diff") > F.greatest(F.lit(CONFLICT_M), CONFLICT_SHARE * F.col("h"))).alias("review"))


@query("height_agreement", f"""WITH {lens.BUILDINGS}, {_TALL}, d AS (SELECT evidence, segment, 5.0 + building_id % 60 - height_m AS e, height_m AS h FROM tall WHERE building_id % 5 <> 0)
 SELECT evidence, segment, count(*)::BIGINT AS n, {rounded_sql('avg(e)', 3)} AS bias, {rounded_sql('avg(abs(e))', 3)} AS mae, count(*) FILTER (abs(e) > greatest({CONFLICT_M}, {CONFLICT_SHARE} * h))::BIGINT AS disagree FROM d GROUP BY ROLLUP (evidence, segment)""")
def height_agreement(spark, sf_dir):
    k = F.col("building_id")
    b = lens.buildings(spark, sf_dir).where(k % 5 != 0).withColumn("t", tags.height(F.col("height_tag"), F.col("levels_tag"))).select("segment", F.col("t.evidence").alias("evidence"), F.col("t.height_m").alias("h"), (5.0 + k % 60 - F.col("t.height_m")).alias("e"))
    return b.rollup("evidence", "segment").agg(F.count("*").alias("n"), rounded(F.avg("e"), 3).alias("bias"), rounded(F.avg(F.abs("e")), 3).alias("mae"), F.count_if(F.abs("e") > F.greatest(F.lit(CONFLICT_M), CONFLICT_SHARE * F.col("h"))).alias("disagree"))


@query("tile_coverage", f"WITH {RASTER} SELECT row // 10 AS tile_row, col // 10 AS tile_col, count(*)::BIGINT AS pixels, {rounded_sql('count(z)::DOUBLE / count(*)', 4)} AS valid FROM lens_raster GROUP BY ALL")
def tile_coverage(spark, sf_dir):
    return raster(spark, sf_dir).groupBy(F.floor(F.col("row") / 10).alias("tile_row"), F.floor(F.col("col") / 10).alias("tile_col")).agg(F.count("*").alias("pixels"), rounded(F.count("z") / F.count("*"), 4).alias("valid"))


@query("slope", f"""WITH {RASTER} SELECT a.row, a.col, {rounded_sql('degrees(atan(sqrt(pow((e.z - w.z) / 800.0, 2) + pow((n.z - s.z) / 800.0, 2))))', 4)} AS degrees FROM lens_raster a JOIN lens_raster e ON e.row = a.row AND e.col = a.col + 1 JOIN lens_raster w ON w.row = a.row AND w.col = a.col - 1 JOIN lens_raster n ON n.row = a.row + 1 AND n.col = a.col JOIN lens_raster s ON s.row = a.row - 1 AND s.col = a.col""")
def slope(spark, sf_dir):
    """Central differences: a pixel is dealt to its four neighbours, one aggregation instead of four self-joins."""
    moves = {"w": (0, 1), "e": (0, -1), "s": (1, 0), "n": (-1, 0)}
    to = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for k, (dr, dc) in moves.items()), F.struct(F.lit("o").alias("k"), F.col("row").alias("row"), F.col("col").alias("col")))
    e = raster(spark, sf_dir).withColumn("m", F.explode(to)).select("m.k", "m.row", "m.col", "z")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("z"))).alias(k)
    q = e.groupBy("row", "col").agg(*map(at, moves), F.count("*").alias("n_parts")).where("n_parts = 5")
    return q.select("row", "col", rounded(F.degrees(F.atan(F.sqrt(F.pow((F.col("e") - F.col("w")) / 800.0, 2) + F.pow((F.col("n") - F.col("s")) / 800.0, 2)))), 4).alias("degrees"))
