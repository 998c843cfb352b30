"""Heights read from a raster under footprints, by every sampling strategy and statistic, and how far they agree with tags.

Pixels meet footprints by their place in the grid. What a footprint reads is one sorted list of values a strategy, so its 24
statistics come from one pass; errors are then summed by strategy, statistic and source, and the policy of the best score is first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geo, tags
from meridia.functions.numeric import rounded, rounded_sql
from meridia.operators import stats
from meridia.operators.tables import shared_table
from meridia.plans import lens
from meridia.plans.buildings import _TALL
from meridia.plans.policy import STATISTICS, STRATEGIES
from meridia.plans.registry import query

#: Degrees of a pixel; metres that the inward mask keeps off the edge; the share of the largest errors that a score counts.
PIXEL, INWARD_M, TAIL = 0.0001, 3.0, 0.25


def _column(x: Column, origin: float) -> Column:
    return F.floor((x - origin) / PIXEL)


def pixels_near(footprints: DataFrame) -> DataFrame:
    """footprints (id, ring, lon, lat, half) with a row for each pixel (px, py) that their box touches."""
    lon, lat, half = F.col("lon"), F.col("lat"), F.col("half")
    x = F.explode(F.sequence(_column(lon - half, lens.WEST), _column(lon + half, lens.WEST)))
    y = F.explode(F.sequence(_column(lat - half, lens.SOUTH), _column(lat + half, lens.SOUTH)))
    return footprints.withColumn("px", x).withColumn("py", y)


def raster(spark, sf_dir) -> DataFrame:
    """(px, py, z): a height model around the buildings, with gaps (null), water (below 0) and bare ground (0)."""
    b = lens.buildings(spark, sf_dir).select("building_id", "lon", "lat", (F.col("half") * 1.5).alias("half"))
    p = pixels_near(b)
    x, y = F.col("px"), F.col("py")
    z = 4.0 + F.col("building_id") % 60 + (x * 7 + y * 13) % 11 / 4.0
    odd = F.when((x + y) % 17 == 0, F.lit(None)).when((x + 2 * y) % 19 == 0, -1.0).when((x + 3 * y) % 23 == 0, 0.0)
    # where buildings overlap the taller one is seen; a gap stays a gap
    gap = (x + y) % 17 == 0
    seen = F.when(gap, None).otherwise(F.coalesce(odd, z))
    return p.groupBy("px", "py").agg(F.max(seen).alias("z"))


def sampled(footprints: DataFrame, pixels: DataFrame) -> DataFrame:
    """(id, strategy, values): the positive heights of the pixels that each strategy takes, sorted; only footprints with one at least.

    Touched by the footprint at all; centre inside; centre inside and INWARD_M from every edge, which is what an inward offset of the
    polygon leaves; and the interior again, for quantiles.
    """
    near = pixels_near(footprints).join(pixels, ["px", "py"]).where("z > 0")
    x, y, ring = lens.WEST + (F.col("px") + 0.5) * PIXEL, lens.SOUTH + (F.col("py") + 0.5) * PIXEL, F.col("ring")
    h = PIXEL / 2
    near = near.withColumn("x", x).withColumn("y", y).withColumn("centre", geo.in_polygon(F.col("x"), F.col("y"), ring))
    x, y = F.col("x"), F.col("y")
    off = ~F.exists(geo.edges(ring), lambda e: geo.to_segment_m(x, y, e["ax"], e["ay"], e["bx"], e["by"]) < INWARD_M)
    takes = {"all_intersecting": F.col("centre") | geo.meets_box(ring, x - h, y - h, x + h, y + h), "pixel_center_inside": F.col("centre"), "inward_buffered": F.col("centre") & off, "robust_interior_quantile": F.col("centre")}
    taken = F.filter(F.array(*(F.when(takes[s], F.lit(s)) for s in STRATEGIES)), lambda s: s.isNotNull())
    return near.select("id", "z", F.explode(taken).alias("strategy")).groupBy("id", "strategy").agg(F.array_sort(F.collect_list("z")).alias("values"))  # pixels of one footprint


def statistics(values: Column) -> dict[str, Column]:
    """The statistics of a sorted list; quantiles between neighbours."""

    def quantile(p: float) -> Column:
        place = (F.size(values) - 1) * p
        low, high = F.element_at(values, (F.floor(place) + 1).cast("int")), F.element_at(values, (F.ceil(place) + 1).cast("int"))
        return low + (place - F.floor(place)) * (high - low)

    return {"median": quantile(0.5), "p75": quantile(0.75), "mean": F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values), "p90": quantile(0.9), "min": F.element_at(values, 1), "max": F.element_at(values, -1)}


def scores(read: DataFrame, tagged: DataFrame) -> DataFrame:
    """read (id, strategy, values) and tagged (id, source, height_m) -> a row a policy: (strategy, statistic, usable, single_share, agreement,
    score, place), best first: mean absolute error and TAIL of its ninetieth percentile by source, the share that one pixel supports, fixed costs."""
    s = F.array(*(F.struct(F.lit(k).alias("statistic"), v.alias("external_m")) for k, v in statistics(F.col("values")).items()))
    e = read.select("id", "strategy", (F.size("values") == 1).alias("single"), F.explode(s).alias("s")).select("id", "strategy", "single", "s.*")
    e = shared_table(e.join(tagged, "id").withColumn("size", F.abs(F.col("external_m") - F.col("height_m"))), "agreement")
    keys = ["strategy", "statistic"]
    of = ("observed_tag", "derived_from_levels")
    known = e.where(F.col("source").isin(*of))
    tail = stats.quantiles(known, [*keys, "source"], "size", {"p90": 0.9})
    by = known.groupBy(*keys, "source").agg(F.avg("size").alias("mae")).join(tail, [*keys, "source"]).groupBy(*keys).agg(F.sum(F.col("mae") + TAIL * F.col("p90")).alias("agreement"))
    g = e.groupBy(*keys).agg(F.count("*").alias("usable"), (F.count_if("single") / F.count("*")).alias("single_share")).join(by, keys, "left").na.fill(0.0, ["agreement"])
    cost = F.create_map(*(F.lit(x) for pair in {**STRATEGIES, **STATISTICS}.items() for x in pair))
    g = g.withColumn("score", rounded(F.col("agreement") + F.col("single_share") + cost[F.col("strategy")] + cost[F.col("statistic")], 6))
    place = F.row_number().over(Window.orderBy("score", F.desc("usable"), "strategy", "statistic"))  # 24 rows
    return g.select(*keys, "usable", rounded(F.col("single_share"), 6).alias("single_share"), rounded(F.col("agreement"), 6).alias("agreement"), "score").withColumn("place", place)


def _near_sql(half: str) -> str:
    span = lambda c, o: f"unnest(range(floor(({c} - {half} - {o}) / {PIXEL})::BIGINT, floor(({c} + {half} - {o}) / {PIXEL})::BIGINT + 1))"
    return f"SELECT *, {span('lat', lens.SOUTH)} AS py FROM (SELECT *, {span('lon', lens.WEST)} AS px FROM lens_buildings)"


_DX, _DY = f"abs({lens.WEST} + (px + 0.5) * {PIXEL} - lon)", f"abs({lens.SOUTH} + (py + 0.5) * {PIXEL} - lat)"
_OFF = f"least((half - {_DX}) * 111320.0 * cos(radians({lens.SOUTH} + (py + 0.5) * {PIXEL})), (half - {_DY}) * 111320.0) >= {INWARD_M}"
_COST = lambda d, c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + " END"
_STUDY = f"""WITH {lens.BUILDINGS}, {_TALL}, q AS ({_near_sql('half * 1.5')}), z AS (SELECT px, py, max(CASE WHEN (px + py) % 17 = 0 THEN NULL WHEN (px + 2 * py) % 19 = 0 THEN -1.0::DOUBLE WHEN (px + 3 * py) % 23 = 0 THEN 0.0::DOUBLE ELSE 4.0 + building_id % 60 + (px * 7 + py * 13) % 11 / 4.0::DOUBLE END) AS z FROM q GROUP BY px, py),
 n AS (SELECT p.*, z FROM ({_near_sql('half')}) p JOIN z USING (px, py) WHERE z > 0), m AS (SELECT building_id, z, {_DX} < half AND {_DY} < half AS inside, {_OFF} AS off FROM n),
 t AS (SELECT building_id, z, unnest(list_filter(['all_intersecting', CASE WHEN inside THEN 'pixel_center_inside' END, CASE WHEN inside AND off THEN 'inward_buffered' END, CASE WHEN inside THEN 'robust_interior_quantile' END], lambda s: s IS NOT NULL)) AS strategy FROM m),
 r AS (SELECT building_id, strategy, count(*) = 1 AS single, {{'median': quantile_cont(z, 0.5), 'p75': quantile_cont(z, 0.75), 'mean': avg(z), 'p90': quantile_cont(z, 0.9), 'min': min(z), 'max': max(z)}} AS s FROM t GROUP BY building_id, strategy),
 u AS ({' UNION ALL '.join(f"SELECT building_id, strategy, single, '{k}' AS statistic, s.{k} AS external_m FROM r" for k in STATISTICS)}), e AS (SELECT u.*, evidence AS source, abs(external_m - height_m) AS size FROM u JOIN tall USING (building_id)),
 b AS (SELECT strategy, statistic, source, avg(size) + {TAIL} * quantile_cont(size, 0.9) AS part FROM e WHERE source IN ('observed_tag', 'derived_from_levels') GROUP BY ALL), a AS (SELECT strategy, statistic, sum(part) AS agreement FROM b GROUP BY ALL),
 g AS (SELECT strategy, statistic, count(*)::BIGINT AS usable, count(*) FILTER (single) / count(*)::DOUBLE AS single_share FROM e GROUP BY ALL),
 c AS (SELECT g.*, coalesce(agreement, 0.0) AS agreement, {rounded_sql(f"coalesce(agreement, 0.0) + single_share + {_COST(STRATEGIES, 'strategy')} + {_COST(STATISTICS, 'statistic')}", 6)} AS score FROM g LEFT JOIN a USING (strategy, statistic))
 SELECT strategy, statistic, usable, {rounded_sql('single_share', 6)} AS single_share, {rounded_sql('agreement', 6)} AS agreement, score, row_number() OVER (ORDER BY score, usable DESC, strategy, statistic)::INTEGER AS place FROM c"""


@query("agreement_study", _STUDY)
def agreement_study(spark, sf_dir):
    """Every sampling strategy and statistic over the pixels under every footprint, by agreement with tagged heights; place 1 is chosen."""
    b = lens.buildings(spark, sf_dir)
    h = tags.height(F.col("height_tag"), F.col("levels_tag"))
    tagged = b.select(F.col("building_id").alias("id"), h.alias("h")).select("id", F.col("h.evidence").alias("source"), "h.height_m")
    read = sampled(b.select(F.col("building_id").alias("id"), "ring", "lon", "lat", "half"), raster(spark, sf_dir))
    return scores(read, tagged)
