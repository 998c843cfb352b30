"""Choices made from measured agreement: error patterns, extraction policies, what a policy would change, sensitivities, representative cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import tags
from meridia.functions.numeric import rounded, rounded_sql
from meridia.operators import stats
from meridia.plans import evidence, lens
from meridia.plans.buildings import _TALL
from meridia.plans.registry import query

#: Sampling strategies and statistics, with the score that each costs.
STRATEGIES = {"all_intersecting": 0.25, "pixel_center_inside": 0.0, "inward_buffered": 0.05, "robust_interior_quantile": 0.0}
STATISTICS = {"median": 0.0, "p75": 0.05, "mean": 0.10, "p90": 0.15, "min": 0.20, "max": 0.30}
_SUPPORT = ([0.0, 1.0, 2.0, 4.0, 10.0], ["0", "1", "2-3", "4-9", "10+"])
_HEIGHTS = ([0.0, 10.0, 20.0, 40.0], ["0-10", "10-20", "20-40", "40+"])
_AREAS = ([0.0, 5000.0, 8000.0, 11000.0], ["small", "medium", "large", "huge"])


def extracted(spark, sf_dir) -> DataFrame:
    """Heights of buildings read from a raster, beside those of tags: source, external height (some missing), pixels behind it."""
    k = F.col("building_id")
    b = lens.buildings(spark, sf_dir).withColumn("t", tags.height(F.col("height_tag"), F.col("levels_tag")))
    return b.select("building_id", "area_m2", F.col("t.height_m").alias("height_m"), F.col("t.evidence").alias("source"), F.when(k % 5 != 0, 5.0 + k % 60).alias("external_m"), F.when(k % 5 == 0, 0).otherwise(k % 14 + 1).alias("pixels"))


_EXTRACTED = f"{lens.BUILDINGS}, {_TALL}, x AS (SELECT t.building_id, t.area_m2, t.height_m, t.evidence AS source, CASE WHEN building_id % 5 <> 0 THEN 5.0 + building_id % 60 END AS external_m, CASE WHEN building_id % 5 = 0 THEN 0 ELSE building_id % 14 + 1 END AS pixels FROM tall t)"


def _bin_sql(x: str, edges: list[float], labels: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {e} THEN '{label}'" for e, label in reversed(list(zip(edges, labels)))) + " END"


_E = f"count(error)::BIGINT AS n, {rounded_sql('avg(error)', 4)} AS bias, {rounded_sql('avg(abs(error))', 4)} AS mae"


@query("error_patterns", f"""WITH {_EXTRACTED}, e AS (SELECT *, external_m - height_m AS error, {_bin_sql('area_m2', *_AREAS)} AS area, {_bin_sql('height_m', *_HEIGHTS)} AS height, {_bin_sql('pixels', *_SUPPORT)} AS support FROM x)
 {' UNION ALL '.join(f"SELECT '{d}' AS dimension, {d} AS bin, {_E} FROM e GROUP BY {d}" for d in ('area', 'height', 'support'))}""")
def error_patterns(spark, sf_dir):
    """Error of the external height by footprint area, tagged height and pixels behind it: one pass, three groupings."""
    x = extracted(spark, sf_dir)
    e = x.select((F.col("external_m") - F.col("height_m")).alias("error"), stats.binned(F.col("area_m2"), *_AREAS).alias("area"), stats.binned(F.col("height_m"), *_HEIGHTS).alias("height"), stats.binned(F.col("pixels").cast("double"), *_SUPPORT).alias("support"))
    u = stats.unpivoted(e, ["area", "height", "support"], ["error"])
    return u.groupBy("dimension", F.col("value").alias("bin")).agg(F.count("error").alias("n"), rounded(F.avg("error"), 4).alias("bias"), rounded(F.avg(F.abs("error")), 4).alias("mae"))


_SHIFT = "(strategy_i * 0.5 + statistic_i * 0.75)"
_POLICY = f"""WITH {_EXTRACTED}, s AS (SELECT strategy, strategy_i, strategy_cost, statistic, statistic_i, statistic_cost FROM (SELECT unnest({list(STRATEGIES)}) AS strategy, unnest(range({len(STRATEGIES)})) AS strategy_i, unnest({[float(v) for v in STRATEGIES.values()]}::DOUBLE[]) AS strategy_cost), (SELECT unnest({list(STATISTICS)}) AS statistic, unnest(range({len(STATISTICS)})) AS statistic_i, unnest({[float(v) for v in STATISTICS.values()]}::DOUBLE[]) AS statistic_cost)),
 e AS (SELECT s.*, source, pixels, abs(external_m - height_m + {_SHIFT}) AS size FROM x, s WHERE external_m IS NOT NULL),
 g AS (SELECT strategy, statistic, any_value(strategy_cost) + any_value(statistic_cost) AS cost, count(*)::BIGINT AS usable, count(*) FILTER (pixels = 1) / count(*)::DOUBLE AS single, coalesce(avg(size) FILTER (source = 'observed_tag'), 0) + coalesce(avg(size) FILTER (source = 'derived_from_levels'), 0) + 0.25 * coalesce(quantile_cont(size, 0.9) FILTER (source = 'observed_tag'), 0) + 0.25 * coalesce(quantile_cont(size, 0.9) FILTER (source = 'derived_from_levels'), 0) AS agreement FROM e GROUP BY strategy, statistic)"""


@query("policy_choice", f"{_POLICY}, r AS (SELECT strategy, statistic, usable, {rounded_sql('single', 6)} AS single_share, {rounded_sql('agreement + single + cost', 6)} AS score FROM g) SELECT *, row_number() OVER (ORDER BY score, usable DESC, strategy, statistic)::INTEGER AS place FROM r")
def policy_choice(spark, sf_dir):
    """Sampling strategies and statistics by a score of disagreement (mean, and a quarter of the ninetieth percentile, by source), single-pixel
    support and fixed costs; place 1 is chosen."""
    rows = [(a, i, float(x), b, j, float(y)) for i, (a, x) in enumerate(STRATEGIES.items()) for j, (b, y) in enumerate(STATISTICS.items())]
    s = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("strategy", "i", "strategy_cost", "statistic", "j", "statistic_cost"), r))) for r in rows))
    e = extracted(spark, sf_dir).where("external_m IS NOT NULL").withColumn("s", F.explode(s))
    size = F.abs(F.col("external_m") - F.col("height_m") + (F.col("s.i") * 0.5 + F.col("s.j") * 0.75))
    of = lambda source: F.coalesce(F.avg(F.when(F.col("source") == source, size)), F.lit(0.0))
    g = e.groupBy(F.col("s.strategy").alias("strategy"), F.col("s.statistic").alias("statistic")).agg(F.any_value(F.col("s.strategy_cost") + F.col("s.statistic_cost")).alias("cost"), F.count("*").alias("usable"), (F.count_if(F.col("pixels") == 1) / F.count("*")).alias("single"), (of("observed_tag") + of("derived_from_levels")).alias("agreement"))
    known = e.where(F.col("source").isin("observed_tag", "derived_from_levels")).select(F.col("s.strategy").alias("strategy"), F.col("s.statistic").alias("statistic"), "source", size.alias("size"))
    tail = stats.quantiles(known, ["strategy", "statistic", "source"], "size", {"p90": 0.9}).groupBy("strategy", "statistic").agg(F.sum(0.25 * F.col("p90")).alias("tail"))
    g = g.join(tail, ["strategy", "statistic"], "left").withColumn("agreement", F.col("agreement") + F.coalesce("tail", F.lit(0.0)))
    r = g.select("strategy", "statistic", "usable", rounded(F.col("single"), 6).alias("single_share"), rounded(F.col("agreement") + F.col("single") + F.col("cost"), 6).alias("score"))
    return r.withColumn("place", F.row_number().over(Window.orderBy("score", F.desc("usable"), "strategy", "statistic")))  # 24 rows


_COUNTS = "count(*) FILTER (source = 'observed_tag')::BIGINT AS explicit, count(*) FILTER (source = 'derived_from_levels')::BIGINT AS levels_before, count(*) FILTER (source NOT IN ('observed_tag', 'derived_from_levels'))::BIGINT AS fallback_before"


@query("policy_impact", f"""WITH {_EXTRACTED}, y AS (SELECT *, external_m IS NOT NULL AS has FROM x), p AS (SELECT 'explicit_levels_external' AS policy, *, has AND source NOT IN ('observed_tag', 'derived_from_levels') AS chosen FROM y UNION ALL SELECT 'explicit_external_levels', *, has AND source <> 'observed_tag' FROM y),
 g AS (SELECT policy, {_COUNTS}, count(*) FILTER (chosen)::BIGINT AS external, count(*) FILTER (chosen AND source = 'derived_from_levels')::BIGINT AS over_levels, count(*) FILTER (has AND source = 'observed_tag')::BIGINT AS explicit_kept, count(*)::BIGINT AS n, count(*) FILTER (has)::BIGINT AS usable, count(*) FILTER (has AND abs(external_m - height_m) > greatest(5.0, 0.25 * height_m))::DOUBLE / greatest(count(*) FILTER (has), 1) AS conflict FROM p GROUP BY policy)
 SELECT policy, explicit, levels_before, levels_before - over_levels AS levels_after, fallback_before, fallback_before - (external - over_levels) AS fallback_after, external, explicit_kept, {rounded_sql('100.0 * (external - over_levels) / greatest(fallback_before, 1)', 4)} AS fallback_cut_pct, {rounded_sql('conflict', 6)} AS conflict_share, CASE WHEN usable::DOUBLE / n >= 0.1 AND conflict < 0.25 AND external > 0 THEN 'go' ELSE 'no_go' END AS decision FROM g""")
def policy_impact(spark, sf_dir):
    """Counts by source before and after a policy lets external heights in, with a gate on coverage and conflicts."""
    has, tagged, levels = F.col("external_m").isNotNull(), F.col("source") == "observed_tag", F.col("source") == "derived_from_levels"
    policy = lambda name, chosen: F.struct(F.lit(name).alias("policy"), chosen.alias("chosen"))
    p = extracted(spark, sf_dir).withColumn("p", F.explode(F.array(policy("explicit_levels_external", has & ~tagged & ~levels), policy("explicit_external_levels", has & ~tagged))))
    chosen, n = F.col("p.chosen"), F.count_if
    conflict = n(has & (F.abs(F.col("external_m") - F.col("height_m")) > F.greatest(F.lit(5.0), 0.25 * F.col("height_m")))) / F.greatest(n(has), F.lit(1))
    g = p.groupBy("p.policy").agg(n(tagged).alias("explicit"), n(levels).alias("levels_before"), n(~tagged & ~levels).alias("fallback_before"), n(chosen).alias("external"), n(chosen & levels).alias("over_levels"), n(has & tagged).alias("explicit_kept"), F.count("*").alias("n"), n(has).alias("usable"), conflict.alias("conflict"))
    gained = F.col("external") - F.col("over_levels")
    go = (F.col("usable") / F.col("n") >= 0.1) & (F.col("conflict") < 0.25) & (F.col("external") > 0)
    return g.select("policy", "explicit", "levels_before", (F.col("levels_before") - F.col("over_levels")).alias("levels_after"), "fallback_before", (F.col("fallback_before") - gained).alias("fallback_after"), "external", "explicit_kept", rounded(100.0 * gained / F.greatest("fallback_before", F.lit(1)), 4).alias("fallback_cut_pct"), rounded(F.col("conflict"), 6).alias("conflict_share"), F.when(go, "go").otherwise("no_go").alias("decision"))


SWEEP = (("tx", 10.0, 1.5), ("tx", 25.0, 1.5), ("tx", 50.0, 1.5), ("rx", 25.0, 3.0), ("rx", 25.0, 5.0), ("rx", 25.0, 10.0))
_PROFILE = evidence._BILINEAR
_PATHS = f"""WITH {lens.SAMPLES}, {evidence.RASTER}, s AS (SELECT sample_id * 8 + i AS id, sample_id, i, lon + 0.004 * i AS lon, lat AS lat FROM lens_samples, range(8) r(i)), z AS (SELECT s.*, z FROM s JOIN {_PROFILE.replace('POINTS', 's')} USING (id)),
 e AS (SELECT *, max(z) FILTER (i = 0) OVER w AS z0, max(z) FILTER (i = 7) OVER w AS z7, count(z) OVER w AS n FROM z WINDOW w AS (PARTITION BY sample_id))"""


def _paths(spark, sf_dir) -> DataFrame:
    """Eight terrain samples due east of each sample point, only where all are known: (sample_id, i, z, z0, z7)."""
    p = lens.samples(spark, sf_dir).select("sample_id", "lon", "lat").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("sample_id", "i", (F.col("lon") + 0.004 * F.col("i")).alias("lon"), "lat")
    z = evidence.bilinear(p, evidence.raster(spark, sf_dir), ["sample_id", "i"])
    one = Window.partitionBy("sample_id")
    return z.withColumn("z0", F.max(F.when(F.col("i") == 0, F.col("z"))).over(one)).withColumn("z7", F.max(F.when(F.col("i") == 7, F.col("z"))).over(one)).withColumn("n", F.count("z").over(one)).where("n = 8")


def _line(tx: Column, rx: Column) -> Column:
    return F.col("z0") + tx + (F.col("z7") + rx - F.col("z0") - tx) * F.col("i") / 7.0 - F.col("z")


@query("clearance_sensitivity", f"""{_PATHS}, h AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, a, b in SWEEP)}) t(sweep, tx, rx)), c AS (SELECT sample_id, sweep, tx, rx, min(z0 + tx + (z7 + rx - z0 - tx) * i / 7.0 - z) AS least FROM e, h WHERE n = 8 GROUP BY ALL)
 SELECT sweep, tx, rx, count(*)::BIGINT AS n, count(*) FILTER (least < 0)::BIGINT AS candidates, {rounded_sql('avg(least)', 4)} AS mean_clearance FROM c GROUP BY ALL""")
def clearance_sensitivity(spark, sf_dir):
    """How the count of obstruction candidates follows the masts' heights: all settings over the same terrain samples, which are read once."""
    h = F.array(*(F.struct(F.lit(k).alias("sweep"), F.lit(a).alias("tx"), F.lit(b).alias("rx")) for k, a, b in SWEEP))
    least = _paths(spark, sf_dir).withColumn("h", F.explode(h)).groupBy("sample_id", "h").agg(F.min(_line(F.col("h.tx"), F.col("h.rx"))).alias("least"))
    return least.groupBy("h").agg(F.count("*").alias("n"), F.count_if(F.col("least") < 0).alias("candidates"), rounded(F.avg("least"), 4).alias("mean_clearance")).select("h.sweep", "h.tx", "h.rx", "n", "candidates", "mean_clearance")


_ROLES = {"strongest": ("true", "least"), "weakest": ("true", "-least"), "near_receiver": ("spot = 6", "least"), "interior": ("spot BETWEEN 2 AND 5", "least")}


@query("representative_profiles", f"""{_PATHS}, m AS (SELECT sample_id, i, z0 + 25.0 + (z7 + 1.5 - z0 - 25.0) * i / 7.0 - z AS clear FROM e WHERE n = 8), c AS (SELECT sample_id, min(clear) AS least, arg_min(i, (clear, i)) AS spot FROM m GROUP BY sample_id HAVING min(clear) < 0)
 {' UNION ALL '.join(f"SELECT '{r}' AS role, arg_min(sample_id, ({x}, sample_id)) AS sample_id, {rounded_sql(f'arg_min(least, ({x}, sample_id))', 4)} AS least FROM c WHERE {cond} HAVING count(*) > 0" for r, (cond, x) in _ROLES.items())}""")
def representative_profiles(spark, sf_dir):
    """One profile for each role: strongest and weakest candidate, nearest to the receiver, inside the path. One aggregation for all roles."""
    m = _paths(spark, sf_dir).select("sample_id", "i", _line(F.lit(25.0), F.lit(1.5)).alias("clear"))
    c = m.groupBy("sample_id").agg(F.min(F.struct("clear", "i")).alias("w")).select("sample_id", F.col("w.clear").alias("least"), F.col("w.i").alias("spot")).where("least < 0")
    pick = lambda cond, x: F.min(F.when(F.expr(cond), F.struct(F.expr(x).alias("x"), "sample_id", "least")))
    a = c.agg(*(pick(*v).alias(k) for k, v in _ROLES.items()))
    roles = F.array(*(F.struct(F.lit(k).alias("role"), F.col(f"{k}.sample_id").alias("sample_id"), F.col(f"{k}.least").alias("least")) for k in _ROLES))
    return a.select(F.explode(roles).alias("r")).where("r.sample_id IS NOT NULL").select("r.role", "r.sample_id", rounded(F.col("r.least"), 4).alias("least"))


@query("systematic_points", f"WITH {lens.BUILDINGS}, n AS (SELECT greatest(1, count(*) // 6000) AS step FROM lens_buildings), r AS (SELECT building_id, row_number() OVER (ORDER BY building_id) - 1 AS i FROM lens_buildings) SELECT building_id, (i // step)::BIGINT AS place FROM r, n WHERE i % step = 0")
def systematic_points(spark, sf_dir):
    """Every k-th building in order of id, so that about 6,000 are taken (a sampling operator)."""
    from meridia.operators.ordered import running

    b = lens.buildings(spark, sf_dir).select("building_id")
    step = b.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 6000)).alias("step"))
    r = running(b, ["building_id"], "rank").join(F.broadcast(step)).withColumn("i", F.col("rank") - 1)  # one row
    return r.where(F.col("i") % F.col("step") == 0).select("building_id", F.floor(F.col("i") / F.col("step")).alias("place"))


@query("demeaned_comparison", f"WITH {lens.SAMPLES}, {evidence.RASTER}, pt AS (SELECT sample_id AS id, lon, lat FROM lens_samples), p AS (SELECT id, z AS a, z + (id % 21) / 10.0 - 0.4 AS b FROM {_PROFILE.replace('POINTS', 'pt')} WHERE z IS NOT NULL AND id % 10 <> 0), m AS (SELECT median(a) AS ma, median(b) AS mb FROM p) SELECT count(*)::BIGINT AS n, {rounded_sql('any_value(mb) - any_value(ma)', 4)} AS offset_m, {rounded_sql('avg(b - a)', 4)} AS bias, {rounded_sql('avg(abs((b - mb) - (a - ma)))', 4)} AS relative_mae FROM p, m")
def demeaned_comparison(spark, sf_dir):
    """Two terrain sources at common points: raw difference, and difference after each source's median is taken off."""
    z = evidence.bilinear(lens.samples(spark, sf_dir).select("sample_id", "lon", "lat"), evidence.raster(spark, sf_dir), ["sample_id"])
    p = z.where("z IS NOT NULL AND sample_id % 10 <> 0").select(F.col("z").alias("a"), (F.col("z") + (F.col("sample_id") % 21) / 10.0 - 0.4).alias("b"))
    m = stats.quantiles(p, [], "a", {"ma": 0.5}).join(stats.quantiles(p, [], "b", {"mb": 0.5}))
    q = p.join(F.broadcast(m))  # one row
    return q.agg(F.count("*").alias("n"), rounded(F.any_value("mb") - F.any_value("ma"), 4).alias("offset_m"), rounded(F.avg(F.col("b") - F.col("a")), 4).alias("bias"), rounded(F.avg(F.abs((F.col("b") - F.col("mb")) - (F.col("a") - F.col("ma")))), 4).alias("relative_mae"))


@query("diagnostic_comparison", f"""WITH {lens.SAMPLES}, v AS (SELECT sample_id, residual * sqrt(2 * (distance_m + 1 + 200.0) / (0.299792458 / ghz * (distance_m + 1) * 200.0)) AS v, sqrt(distance_m * distance_m + 552.25) AS slant, distance_m, ghz, los FROM lens_samples),
 l AS (SELECT *, 55.0 - (20 * log10(greatest(slant, 1.0)) + 20 * log10(ghz) + 32.45) - CASE WHEN v <= -0.78 THEN 0.0 ELSE greatest(0.0, 6.9 + 20 * log10(sqrt(pow(v - 0.1, 2) + 1) + v - 0.1)) END AS diagnostic, CASE WHEN NOT distance_m BETWEEN 10 AND 5000 THEN 'distance_out_of_range' WHEN los = 'unknown' THEN 'required_los_or_nlos_missing' ELSE 'available' END AS reason, 4 * 24.0 * 0.5 * ghz * 1e9 / 3e8 AS bp FROM v),
 c AS (SELECT *, CASE WHEN distance_m > bp THEN 28 + 40 * log10(greatest(slant, 1.0)) + 20 * log10(ghz) - 9 * log10(bp * bp + 552.25) ELSE 28 + 22 * log10(greatest(slant, 1.0)) + 20 * log10(ghz) END AS seen FROM l)
 SELECT sample_id, reason, {rounded_sql("CASE WHEN reason = 'available' THEN diagnostic - (55.0 - CASE WHEN los = 'los' THEN seen ELSE greatest(seen, 13.54 + 39.08 * log10(greatest(slant, 1.0)) + 20 * log10(ghz) - 0.0) END) END", 3)} AS difference_db FROM c""")
def diagnostic_comparison(spark, sf_dir):
    """Power by a diffraction diagnostic less power by the urban model: alternatives, never summed."""
    from meridia.functions import rf

    c, tx, rx = F.col, F.lit(25.0), F.lit(1.5)
    slant = rf.slant_m(c("distance_m"), tx, rx)
    diagnostic = 55.0 - rf.free_space_loss(slant, c("ghz")) - rf.knife_edge_loss(rf.knife_edge_v(c("residual"), c("distance_m") + 1, F.lit(200.0), c("ghz")))
    refusal = rf.urban_refusal(c("distance_m"), c("ghz"), tx, rx, F.lit(True), F.lit(True), c("los"))
    canonical = 55.0 - rf.urban_loss(c("distance_m"), slant, c("ghz"), tx, rx, c("los") == "los")
    s = lens.samples(spark, sf_dir).withColumn("reason", F.coalesce(refusal, F.lit("available")))
    return s.select("sample_id", "reason", rounded(F.when(c("reason") == "available", diagnostic - canonical), 3).alias("difference_db"))
