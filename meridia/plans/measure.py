"""Residual validation over measurement samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.functions.numeric import rounded, rounded_sql
from meridia.operators import stats
from meridia.plans import lens
from meridia.plans.registry import query

_W = f"WITH {lens.SAMPLES}"
_M = f"count(residual)::BIGINT AS n, {rounded_sql('avg(abs(residual))', 4)} AS mae, {rounded_sql('sqrt(avg(residual * residual))', 4)} AS rmse, {rounded_sql('avg(residual)', 4)} AS bias"
_BINS = ([0.0, 100.0, 250.0, 500.0, 1000.0], ["0-100 m", "100-250 m", "250-500 m", "500 m-1 km", "1 km+"])
_BIN_SQL = "CASE WHEN distance_m >= 1000 THEN '1 km+' WHEN distance_m >= 500 THEN '500 m-1 km' WHEN distance_m >= 250 THEN '250-500 m' WHEN distance_m >= 100 THEN '100-250 m' WHEN distance_m >= 0 THEN '0-100 m' END"


@query("residual_metrics", f"{_W} SELECT {_M}, {rounded_sql('median(residual)', 4)} AS median, {rounded_sql('quantile_cont(abs(residual), 0.5)', 4)} AS p50_abs, {rounded_sql('quantile_cont(abs(residual), 0.9)', 4)} AS p90_abs FROM lens_samples")
def residual_metrics(spark, sf_dir):
    s = lens.samples(spark, sf_dir).withColumn("size", F.abs("residual"))
    q = stats.quantiles(s, [], "residual", {"median": 0.5}).join(F.broadcast(stats.quantiles(s, [], "size", {"p50_abs": 0.5, "p90_abs": 0.9})))  # one row each
    return s.agg(*stats.metrics()).join(F.broadcast(q)).select("n", "mae", "rmse", "bias", *(rounded(F.col(c), 4).alias(c) for c in ("median", "p50_abs", "p90_abs")))


@query("nearest_rank_percentiles", f"{_W} SELECT class, {', '.join(f'quantile_disc(rsrp, {p / 100}) AS p{p}' for p in (1, 10, 50, 90, 99))} FROM lens_samples GROUP BY class")
def nearest_rank_percentiles(spark, sf_dir):
    return stats.quantiles(lens.samples(spark, sf_dir), ["class"], "rsrp", ranks={f"p{p}": p / 100 for p in (1, 10, 50, 90, 99)})


@query("linear_percentiles", f"{_W} SELECT site_id, {', '.join(rounded_sql(f'quantile_cont(rsrp, {p / 100})', 5) + f' AS p{p}' for p in (1, 10, 50, 90, 99))} FROM lens_samples GROUP BY site_id")
def linear_percentiles(spark, sf_dir):
    q = stats.quantiles(lens.samples(spark, sf_dir), ["site_id"], "rsrp", {f"p{p}": p / 100 for p in (1, 10, 50, 90, 99)})
    return q.select("site_id", *(rounded(F.col(f"p{p}"), 5).alias(f"p{p}") for p in (1, 10, 50, 90, 99)))


@query("residual_outliers_mad", f"""{_W}, m AS (SELECT median(residual) AS median FROM lens_samples), t AS (SELECT any_value(m.median) AS median, greatest(6.0, 3 * 1.4826 * median(abs(residual - m.median))) AS threshold FROM lens_samples, m)
 SELECT sample_id, residual, {rounded_sql('threshold', 4)} AS threshold FROM lens_samples, t WHERE abs(residual - t.median) > threshold""")
def residual_outliers_mad(spark, sf_dir):
    s = lens.samples(spark, sf_dir).select("sample_id", "residual")
    return stats.robust_outliers(s).where("outlier").select("sample_id", "residual", rounded(F.col("threshold"), 4).alias("threshold"))


@query("residual_bins", f"{_W} SELECT 'distance' AS dimension, {_BIN_SQL} AS bin, {_M} FROM lens_samples GROUP BY 2 UNION ALL SELECT 'walls', CASE WHEN walls >= 3 THEN '3+' ELSE walls::VARCHAR END, {_M} FROM lens_samples GROUP BY 2")
def residual_bins(spark, sf_dir):
    s = lens.samples(spark, sf_dir).select("residual", stats.binned(F.col("distance_m"), *_BINS).alias("distance"), F.when(F.col("walls") >= 3, "3+").otherwise(F.col("walls").cast("string")).alias("walls"))
    return stats.unpivoted(s, ["distance", "walls"], ["residual"]).groupBy("dimension", F.col("value").alias("bin")).agg(*stats.metrics())


@query("band_cell_stats", f"{_W} SELECT cell_id, ghz, {_M} FROM lens_samples GROUP BY cell_id, ghz")
def band_cell_stats(spark, sf_dir):
    return lens.samples(spark, sf_dir).groupBy("cell_id", "ghz").agg(*stats.metrics())


_DIMS = ["ghz", "los", "bin", "site_id", "campaign"]


@query("metric_grouping_sets", f"{_W} SELECT class, ghz, los, bin, site_id, campaign, {_M} FROM (SELECT * REPLACE (site_id::VARCHAR AS site_id, campaign::VARCHAR AS campaign), {_BIN_SQL} AS bin FROM lens_samples) GROUP BY GROUPING SETS ((class), {', '.join(f'(class, {d})' for d in _DIMS)})")
def metric_grouping_sets(spark, sf_dir):
    s = lens.samples(spark, sf_dir).withColumns({"bin": stats.binned(F.col("distance_m"), *_BINS), "site_id": F.col("site_id").cast("string"), "campaign": F.col("campaign").cast("string")})
    return stats.by_dimensions(s, ["class"], _DIMS, stats.metrics())


@query("strata_unpivot", f"{_W} SELECT dimension, value, {_M} FROM (UNPIVOT (SELECT residual, los, class, site_id::VARCHAR AS site_id, walls::VARCHAR AS walls FROM lens_samples) ON los, class, site_id, walls INTO NAME dimension VALUE value) GROUP BY dimension, value")
def strata_unpivot(spark, sf_dir):
    return stats.unpivoted(lens.samples(spark, sf_dir), ["los", "class", "site_id", "walls"], ["residual"]).groupBy("dimension", "value").agg(*stats.metrics())


@query("slope_correlation", f"{_W} SELECT ghz, {rounded_sql('coalesce(regr_slope(residual, log10(distance_m + 1)), 0)', 4)} AS slope, {rounded_sql('coalesce(corr(residual, log10(distance_m + 1)), 0)', 4)} AS r FROM lens_samples GROUP BY ghz")
def slope_correlation(spark, sf_dir):
    s = lens.samples(spark, sf_dir).withColumn("log_d", F.log10(F.col("distance_m") + 1))
    return s.groupBy("ghz").agg(rounded(F.coalesce(F.regr_slope("residual", "log_d"), F.lit(0.0)), 4).alias("slope"), rounded(F.coalesce(F.corr("residual", "log_d"), F.lit(0.0)), 4).alias("r"))


_FOLDS = f"""{_W}, o AS (SELECT lon AS olon, lat AS olat FROM lens_samples ORDER BY sample_id LIMIT 1),
 pl AS (SELECT s.*, (lon - olon) * 111320.0 * cos(radians(olat)) AS x, (lat - olat) * 110540.0 AS y FROM lens_samples s, o), g AS (SELECT *, floor(x / 50.0)::BIGINT AS gx, floor(y / 50.0)::BIGINT AS gy FROM pl),
 sq AS (SELECT DISTINCT gx, gy FROM g), w AS (SELECT max(x) - min(x) >= max(y) - min(y) AS wide FROM g),
 f AS (SELECT gx, gy, floor((row_number() OVER (ORDER BY CASE WHEN wide THEN gx ELSE gy END, gx, gy) - 1) * 5 / count(*) OVER ())::BIGINT AS fold FROM sq, w),
 d AS (SELECT g.*, fold FROM g JOIN f USING (gx, gy))"""


@query("spatial_folds", f"{_FOLDS} SELECT fold, count(*)::BIGINT AS n, count(DISTINCT (gx, gy))::BIGINT AS n_squares FROM d GROUP BY fold")
def spatial_folds(spark, sf_dir):
    f = stats.spatial_folds(lens.samples(spark, sf_dir).select("sample_id", "lon", "lat"))
    return f.groupBy("fold", "gx", "gy").agg(F.count("*").alias("k")).groupBy("fold").agg(F.sum("k").alias("n"), F.count("*").alias("n_squares"))


@query("fold_bias_cv", f"""{_FOLDS}, b AS (SELECT f.fold, median(d.residual) AS correction FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold)
 SELECT fold, count(*)::BIGINT AS n, {rounded_sql('any_value(correction)', 4)} AS correction, {rounded_sql('sqrt(avg(residual * residual))', 4)} AS rmse_before, {rounded_sql('sqrt(avg((residual - correction) * (residual - correction)))', 4)} AS rmse_after FROM d JOIN b USING (fold) GROUP BY fold""")
def fold_bias_cv(spark, sf_dir):
    f = stats.spatial_folds(lens.samples(spark, sf_dir).select("sample_id", "lon", "lat", "residual")).select("fold", "residual")
    # each row goes to the four training sets that it is not held out of
    train = f.withColumn("held", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k != F.col("fold"))))
    bias = stats.quantiles(train.select(F.col("held").cast("long").alias("fold"), "residual"), ["fold"], "residual", {"correction": 0.5})
    after = F.col("residual") - F.col("correction")
    return f.join(bias, "fold").groupBy("fold").agg(F.count("*").alias("n"), rounded(F.first("correction"), 4).alias("correction"), rounded(F.sqrt(F.avg(F.col("residual") * F.col("residual"))), 4).alias("rmse_before"), rounded(F.sqrt(F.avg(after * after)), 4).alias("rmse_after"))


@query("bias_calibration", f"""{_FOLDS}, k AS (SELECT *, residual + 8.0 AS shifted FROM d), b AS (SELECT f.fold, median(k.shifted) AS correction FROM (SELECT DISTINCT fold FROM k) f JOIN k ON k.fold <> f.fold GROUP BY f.fold),
 e AS (SELECT abs(shifted) AS before, abs(shifted - correction) AS after FROM k JOIN b USING (fold)), q AS (SELECT count(*)::BIGINT AS n, count(DISTINCT (gx, gy))::BIGINT AS squares, greatest(max(gx) - min(gx) + 1, max(gy) - min(gy) + 1) * 50.0 AS span_m, median(shifted) AS adjustment FROM k),
 m AS (SELECT avg(before) AS mae_before, avg(after) AS mae_after, quantile_cont(after, 0.5) AS p50, quantile_cont(after, 0.9) AS p90 FROM e),
 r AS (SELECT *, CASE WHEN n < 20 THEN 'too_few_samples' WHEN squares < 5 OR span_m < 100 THEN 'spatial_diversity' WHEN abs(2.0 + adjustment) > 40 THEN 'out_of_range' WHEN NOT mae_after < mae_before THEN 'no_improvement' END AS reason FROM q, m)
 SELECT n, squares, span_m::DOUBLE AS span_m, reason IS NULL AS eligible, reason, {', '.join(f"{rounded_sql(c, 4)} AS {c}" for c in ('mae_before', 'mae_after', 'p50', 'p90'))}, CASE WHEN reason IS NULL THEN {rounded_sql('adjustment', 4)} END AS adjustment, CASE WHEN reason IS NULL THEN {rounded_sql('2.0 + adjustment', 4)} END AS total_offset FROM r""")
def bias_calibration(spark, sf_dir):
    """A bias correction of shifted residuals, let through by every gate or refused by the first."""
    s = lens.samples(spark, sf_dir).select("sample_id", "lon", "lat", (F.col("residual") + 8.0).alias("residual"))
    c = stats.calibration(s, 2.0)
    return c.select("n", "squares", "span_m", "eligible", "reason", *(rounded(F.col(x), 4).alias(x) for x in ("mae_before", "mae_after", "p50", "p90", "adjustment", "total_offset")))


@query("median_ci", f"""{_W}, s AS (SELECT residual, row_number() OVER (ORDER BY residual) - 1 AS i, count(*) OVER () AS n FROM lens_samples)
 SELECT n::BIGINT AS n, max(residual) FILTER (i = greatest(0, n // 2 - ceil(0.98 * sqrt(n)))) AS lower, max(residual) FILTER (i = least(n - 1, n // 2 + ceil(0.98 * sqrt(n)))) AS upper FROM s GROUP BY n""")
def median_ci(spark, sf_dir):
    return stats.median_bounds(lens.samples(spark, sf_dir))


_PAIR = "SELECT sample_id, 'free_space' AS model, residual FROM lens_samples WHERE sample_id % 3 <> 0 UNION ALL SELECT sample_id, 'urban', residual - 2 FROM lens_samples WHERE sample_id % 4 <> 0 UNION ALL SELECT sample_id, 'local', residual / 2 FROM lens_samples WHERE sample_id % 5 <> 0"


@query("common_samples", f"{_W}, p AS ({_PAIR}) SELECT a.model AS model_a, b.model AS model_b, count(*)::BIGINT AS n, {rounded_sql('sqrt(avg(a.residual * a.residual))', 4)} AS rmse_a, {rounded_sql('sqrt(avg(b.residual * b.residual))', 4)} AS rmse_b FROM p a JOIN p b ON a.sample_id = b.sample_id AND a.model < b.model GROUP BY ALL")
def common_samples(spark, sf_dir):
    """Every pair of models over the samples that both predict."""
    s = lens.samples(spark, sf_dir).select("sample_id", "residual")
    k = F.col("sample_id")
    p = s.where(k % 3 != 0).withColumn("model", F.lit("free_space")).unionByName(s.where(k % 4 != 0).withColumns({"residual": F.col("residual") - 2, "model": F.lit("urban")})).unionByName(s.where(k % 5 != 0).withColumns({"residual": F.col("residual") / 2, "model": F.lit("local")}))
    a, b = p.toDF("sample_id", "ra", "model_a"), p.toDF("sample_id", "rb", "model_b")
    both = a.join(b, "sample_id").where("model_a < model_b")
    return both.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), rounded(F.sqrt(F.avg(F.col("ra") * F.col("ra"))), 4).alias("rmse_a"), rounded(F.sqrt(F.avg(F.col("rb") * F.col("rb"))), 4).alias("rmse_b"))


@query("group_holdout", f"""{_W}, t AS (SELECT campaign, count(*) AS n, sum(residual) AS s FROM lens_samples GROUP BY campaign), a AS (SELECT sum(n) AS n, sum(s) AS s FROM t)
 SELECT l.campaign, count(*)::BIGINT AS n, {rounded_sql('any_value((a.s - t.s) / (a.n - t.n))', 3)} AS correction, {rounded_sql('avg(abs(residual - (a.s - t.s) / (a.n - t.n)))', 3)} AS mae_after FROM lens_samples l JOIN t USING (campaign), a WHERE a.n > t.n GROUP BY l.campaign""")
def group_holdout(spark, sf_dir):
    """Leave one group out: the bias of all other groups corrects it. Sums of groups are subtracted; no group is read twice."""
    s = lens.samples(spark, sf_dir).select("campaign", "residual")
    per = s.groupBy("campaign").agg(F.count("*").alias("n_own"), F.sum("residual").alias("s_own"))
    every = per.agg(F.sum("n_own").alias("n_all"), F.sum("s_own").alias("s_all"))
    c = per.join(every).where("n_all > n_own").select("campaign", ((F.col("s_all") - F.col("s_own")) / (F.col("n_all") - F.col("n_own"))).alias("c"))
    return s.join(c, "campaign").groupBy("campaign").agg(F.count("*").alias("n"), rounded(F.first("c"), 3).alias("correction"), rounded(F.avg(F.abs(F.col("residual") - F.col("c"))), 3).alias("mae_after"))


@query("distribution", f"{_W} SELECT los, count(*)::BIGINT AS n, min(rsrp) AS least, {', '.join(rounded_sql(f'quantile_cont(rsrp, {p})', 5) + f' AS p{int(p * 100)}' for p in (0.01, 0.1, 0.5, 0.75, 0.9, 0.99))}, {rounded_sql('avg(rsrp)', 4)} AS mean, {rounded_sql('stddev_pop(rsrp)', 4)} AS deviation, max(rsrp) AS most FROM lens_samples GROUP BY los")
def distribution(spark, sf_dir):
    s = lens.samples(spark, sf_dir).select("los", "rsrp")
    q = stats.quantiles(s, ["los"], "rsrp", {f"p{int(p * 100)}": p for p in (0.01, 0.1, 0.5, 0.75, 0.9, 0.99)})
    m = s.groupBy("los").agg(F.count("*").alias("n"), F.min("rsrp").alias("least"), rounded(F.avg("rsrp"), 4).alias("mean"), rounded(F.stddev_pop("rsrp"), 4).alias("deviation"), F.max("rsrp").alias("most"))
    return m.join(q, "los").select("los", "n", "least", *(rounded(F.col(c), 5).alias(c) for c in q.columns if c != "los"), "mean", "deviation", "most")


@query("binned_distribution", f"{_W}, b(low) AS (SELECT range * 10 - 150 FROM range(12)) SELECT low::BIGINT AS low, count(rsrp)::BIGINT AS n FROM b LEFT JOIN lens_samples ON rsrp >= low AND rsrp < low + 10 GROUP BY low")
def binned_distribution(spark, sf_dir):
    """Half-open bins, empty ones too."""
    bins = spark.range(12).select((F.col("id") * 10 - 150).alias("low"))
    counts = lens.samples(spark, sf_dir).groupBy((F.floor(F.col("rsrp") / 10) * 10).alias("low")).agg(F.count("*").alias("n"))
    return bins.join(counts, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"))


@query("stability", f"{_W}, s AS (SELECT site_id, sqrt(avg(residual * residual)) AS rmse, avg(residual) AS bias FROM lens_samples GROUP BY site_id) SELECT count(*)::BIGINT AS groups, {rounded_sql('max(bias) - min(bias)', 3)} AS bias_spread, max(rmse) <= 1 AND max(bias) - min(bias) <= 2 AS stable FROM s")
def stability(spark, sf_dir):
    g = lens.samples(spark, sf_dir).groupBy("site_id").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), F.avg("residual").alias("bias"))
    spread = F.max("bias") - F.min("bias")
    return g.agg(F.count("*").alias("groups"), rounded(spread, 3).alias("bias_spread"), ((F.max("rmse") <= 1) & (spread <= 2)).alias("stable"))


@query("transmitter_match", f"""{_W}, {lens.CELLS}, n AS (SELECT s.sample_id, c.cell_id, row_number() OVER (PARTITION BY s.sample_id ORDER BY sqrt(pow((c.lon - s.lon) * 111320.0 * cos(radians(s.lat)), 2) + pow((c.lat - s.lat) * 111320.0, 2)), c.cell_id) AS r
  FROM lens_samples s JOIN lens_cells c ON c.ghz = s.ghz AND sqrt(pow((c.lon - s.lon) * 111320.0 * cos(radians(s.lat)), 2) + pow((c.lat - s.lat) * 111320.0, 2)) <= 250)
 SELECT s.sample_id, CASE WHEN e.cell_id IS NOT NULL THEN 'explicit' WHEN n.cell_id IS NOT NULL THEN 'nearest' ELSE 'unresolved' END AS rule, coalesce(e.cell_id, n.cell_id, -1) AS matched FROM lens_samples s LEFT JOIN lens_cells e ON e.cell_id = s.cell_id AND e.ghz = s.ghz LEFT JOIN n ON n.sample_id = s.sample_id AND n.r = 1""")
def transmitter_match(spark, sf_dir):
    """A sample's transmitter: the one it names (if its frequency fits), else the nearest of its frequency within 250 m."""
    from meridia.functions import geo
    from meridia.operators.joins import box_join, top_rows

    s = lens.samples(spark, sf_dir).select("sample_id", "lon", "lat", "cell_id", "ghz")
    c = lens.cells(spark, sf_dir).select(F.col("cell_id").alias("c_id"), F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"), F.col("ghz").alias("c_ghz"))
    named = s.join(c, (F.col("cell_id") == F.col("c_id")) & (F.col("ghz") == F.col("c_ghz"))).select("sample_id", F.col("c_id").alias("named"))
    near = box_join(s, "lon", "lat", c, geo.bounds_around(F.col("c_lon"), F.col("c_lat"), F.lit(260.0))).where("ghz = c_ghz")
    near = near.withColumn("d", geo.distance_m(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat"))).where("d <= 250")
    near = top_rows(near, ["sample_id"], ["d", "c_id"]).select("sample_id", F.col("c_id").alias("near"))
    out = s.join(named, "sample_id", "left").join(near, "sample_id", "left")
    return out.select("sample_id", F.when(F.col("named").isNotNull(), "explicit").when(F.col("near").isNotNull(), "nearest").otherwise("unresolved").alias("rule"), F.coalesce("named", "near", F.lit(-1)).alias("matched"))
