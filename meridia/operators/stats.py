"""Residual statistics: metrics, robust outliers, bins, folds, and confidence bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.numeric import rounded
from meridia.operators.ordered import running


def nearest_rank(column: str, share: float) -> Column:
    """The value of rank ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def linear_quantile(column: str, share: float) -> Column:
    return F.expr(f"percentile({column}, {share})")


def quantiles(df: DataFrame, keys: list[str], column: str, linear: dict[str, float] | None = None, ranks: dict[str, float] | None = None) -> DataFrame:
    """(keys, names): exact quantiles by key, between neighbours (``linear``) or of rank ceil(share * n) (``ranks``).

    Equal values are counted before anything is ordered, and running counts are sorts that spill, so no aggregation buffer
    holds a group's values; without keys the order is dealt to ranges.
    """
    tally = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_value")).agg(F.count("*").alias("_k"))
    if keys:
        run = tally.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*keys).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        run = run.join(tally.groupBy(*keys).agg(F.sum("_k").alias("_n")), keys)
    else:
        run = running(tally, ["_value"], "_upto", F.col("_k")).join(F.broadcast(tally.agg(F.sum("_k").alias("_n"))))  # one row
    n, out = F.col("_n"), []
    for name, share in (linear or {}).items():
        place = share * (n - 1)
        low, high = F.min(F.when(F.col("_upto") > F.floor(place), F.col("_value"))), F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_value")))
        part = F.max(place - F.floor(place))
        out.append((low + part * (high - low)).alias(name))
    for name, share in (ranks or {}).items():
        out.append(F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), n - F.floor(n - share * n)), F.col("_value"))).alias(name))
    return run.groupBy(*keys).agg(*out)


def metrics(column: str = "residual") -> list[Column]:
    """Count, mean absolute error, root mean square, and bias, to 4 digits."""
    x = F.col(column)
    return [F.count(x).alias("n"), rounded(F.avg(F.abs(x)), 4).alias("mae"), rounded(F.sqrt(F.avg(x * x)), 4).alias("rmse"), rounded(F.avg(x), 4).alias("bias")]


def by_dimensions(df: DataFrame, shared: list[str], dimensions: list[str], aggregates: list[Column]) -> DataFrame:
    """The aggregates over all rows and by each single dimension, always with the shared keys: one pass by grouping sets."""
    sets = [[F.col(c) for c in shared]] + [[F.col(c) for c in (*shared, d)] for d in dimensions]
    return df.groupingSets(sets, *map(F.col, (*shared, *dimensions))).agg(*aggregates)


def unpivoted(df: DataFrame, dimensions: list[str], keep: list[str]) -> DataFrame:
    """One row for each dimension of a row: (keep, dimension, value)."""
    pairs = ", ".join(f"'{d}', CAST({d} AS STRING)" for d in dimensions)
    return df.selectExpr(*keep, f"stack({len(dimensions)}, {pairs}) AS (dimension, value)")


def robust_outliers(df: DataFrame, column: str = "residual", least: float = 6.0) -> DataFrame:
    """df with median, threshold (3 scaled median deviations, at least ``least``) and outlier; one-row medians are joined back."""
    middle = quantiles(df, [], column, {"median": 0.5})
    apart = df.join(F.broadcast(middle)).select(F.abs(F.col(column) - F.col("median")).alias("_d"))  # a single row
    spread = quantiles(apart, [], "_d", {"mad": 0.5}).join(F.broadcast(middle)).select("median", F.greatest(F.lit(least), 3 * 1.4826 * F.col("mad")).alias("threshold"))
    return df.join(F.broadcast(spread)).withColumn("outlier", F.abs(F.col(column) - F.col("median")) > F.col("threshold"))


def binned(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the half-open bin [edge, next edge) of a value; the last bin is open above."""
    out = F.lit(None).cast("string")
    for low, label in sorted(zip(edges, labels)):
        out = F.when(value >= low, label).otherwise(out)
    return out


def spatial_folds(df: DataFrame, k: int = 5, side_m: float = 50.0) -> DataFrame:
    """(gx, gy, fold) of occupied grid squares, cut into k runs along the wider axis. Only squares are ordered, not rows."""
    o = df.agg(F.min_by(F.struct("lon", "lat"), "sample_id").alias("o"))
    placed = df.join(o).withColumn("x", (F.col("lon") - F.col("o.lon")) * 111320.0 * F.cos(F.radians(F.col("o.lat")))).withColumn("y", (F.col("lat") - F.col("o.lat")) * 110540.0)
    placed = placed.withColumn("gx", F.floor(F.col("x") / side_m)).withColumn("gy", F.floor(F.col("y") / side_m))
    squares = placed.groupBy("gx", "gy").agg(F.min("x").alias("x"), F.max("x").alias("x1"), F.min("y").alias("y"), F.max("y").alias("y1"))
    wide = squares.agg((F.max("x1") - F.min("x") >= F.max("y1") - F.min("y")).alias("wide"), F.count("*").alias("n"))
    along = squares.select("gx", "gy").join(wide).withColumn("along", F.when(F.col("wide"), F.col("gx")).otherwise(F.col("gy")))
    folds = running(along, ["along", "gx", "gy"], "place").select("gx", "gy", F.floor((F.col("place") - 1) * k / F.col("n")).cast("long").alias("fold"))
    return placed.drop("o", "x", "y").join(folds, ["gx", "gy"])


def median_bounds(df: DataFrame, column: str = "residual") -> DataFrame:
    """(n, lower, upper): order statistics at ceil(0.98 sqrt(n)) places either side of the middle, by exact percentiles of rank."""
    n = df.agg(F.count(column).alias("n"))
    n = n.withColumn("half", F.ceil(0.98 * F.sqrt("n"))).withColumn("mid", F.floor(F.col("n") / 2))
    n = n.select("n", F.greatest(F.lit(0), F.col("mid") - F.col("half")).alias("lo"), F.least(F.col("n") - 1, F.col("mid") + F.col("half")).alias("hi"))
    # distinct values with running counts: ties collapse before anything is ordered
    tally = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("k"))
    run = running(tally, [column], "upto", F.col("k"))
    at = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col(column)))
    return run.join(n).groupBy("n").agg(at("lo").alias("lower"), at("hi").alias("upper"))


#: What a bias correction needs (samples, 50 m squares, their span in metres) and the most it may be in dB.
LEAST_SAMPLES, LEAST_SQUARES, LEAST_SPAN_M, MOST_OFFSET_DB = 20, 5, 100.0, 40.0


def calibration(df: DataFrame, offset_db: float = 0.0, expired: bool = False) -> DataFrame:
    """One row: whether the median of ``residual`` is fit to correct samples (sample_id, lon, lat, residual), and the first gate that says no.

    Gates in order: too few samples, too few or too narrow squares, a total beyond the range, expired provenance, and no better error
    on spatial folds that the correction was not taken from. With the errors before and after, and the correction if all agree.
    """
    f = spatial_folds(df.where("residual IS NOT NULL")).select("gx", "gy", "fold", "lon", "lat", "residual")
    squares = f.groupBy("gx", "gy").agg(F.count("*").alias("n"))
    wide = (F.max("gx") - F.min("gx") + 1) * 50.0
    high = (F.max("gy") - F.min("gy") + 1) * 50.0
    whole = squares.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("squares"), F.coalesce(F.greatest(wide, high), F.lit(0.0)).alias("span_m"))
    train = f.withColumn("held", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k != F.col("fold"))))
    bias = quantiles(train.select(F.col("held").cast("long").alias("fold"), "residual"), ["fold"], "residual", {"correction": 0.5})
    e = f.join(bias, "fold").select(F.abs("residual").alias("before"), F.abs(F.col("residual") - F.col("correction")).alias("after"))
    errors = e.agg(F.avg("before").alias("mae_before"), F.avg("after").alias("mae_after"))
    tails = quantiles(e, [], "after", {"p50": 0.5, "p90": 0.9})
    one = whole.join(quantiles(f, [], "residual", {"adjustment": 0.5})).join(errors).join(tails)  # a row each
    total = F.lit(offset_db) + F.col("adjustment")
    reason = (
        F.when(F.col("n") < LEAST_SAMPLES, "too_few_samples").when((F.col("squares") < LEAST_SQUARES) | (F.col("span_m") < LEAST_SPAN_M), "spatial_diversity").when(F.abs(total) > MOST_OFFSET_DB, "out_of_range")
        .when(F.lit(expired), "expired").when(~F.coalesce(F.col("mae_after") < F.col("mae_before"), F.lit(False)), "no_improvement")
    )
    fit = lambda x: F.when(reason.isNull(), x)
    return one.select("n", "squares", "span_m", reason.isNull().alias("eligible"), reason.alias("reason"), *(F.col(c) for c in ("mae_before", "mae_after", "p50", "p90")), fit(F.col("adjustment")).alias("adjustment"), fit(total).alias("total_offset"))
