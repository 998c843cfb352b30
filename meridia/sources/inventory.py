"""Cell inventories from CSV or GeoJSON files, and ids that cells without a good one are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions.identity import positive_integer
from meridia.operators.tables import at_most
from meridia.sources import geojson

#: Names that a file may use for a field, best first; how many cells an inventory has; bytes of an id.
ALIASES = {
    "lon": ("longitude", "lon", "tower_lon"), "lat": ("latitude", "lat", "tower_lat"), "id": ("id", "cell_id", "cellid"), "cell_id": ("cell_id", "cellid"), "tech": ("network_tech", "networktech", "radio_type", "radiotype"),
    "ghz": ("frequency_ghz", "frequencyghz"), "mhz": ("bandwidth_mhz", "bandwidthmhz"), "power_dbm": ("tx_power_dbm", "txpowerdbm"), "radius_m": ("radius_m", "radiusmeters"), "beam_deg": ("beam_width", "beamwidthdeg"), "azimuth": ("orientation_deg", "orientationdeg"), "simulated": ("is_simulated", "issimulated"),
}
MOST_CELLS, MOST_ID_BYTES = 10_000, 128


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(place, id, cell_id, lon, lat, tech, ghz, mhz, power_dbm, radius_m, beam_deg, azimuth, simulated, problem) in file order.

    An id that occurs again gets a number behind it; a missing one is ``imported-`` and its place. ``problem`` names the first
    rule a row breaks. A path may hold many inventories: each file is one, with places and ids of its own (the last column is
    ``file``), and more than MOST_CELLS rows in one are an error.
    """
    if path.lower().endswith(".csv"):
        raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        pairs = [x for c in raw.columns for x in (F.lit(c.strip().lstrip("﻿").lower()), F.col(f"`{c}`"))]
        rows = raw.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.create_map(*pairs).alias("tags"), F.lit(None).cast("array<double>").alias("point"))
    else:
        f = geojson.features(spark, path).where("kind = 'Point'")
        own = F.map_filter("tags", lambda k, v: v.isNotNull())
        rows = f.select(F.input_file_name().alias("file"), F.col("index").alias("at"), own.alias("tags"), F.from_json("coordinates", "array<double>").alias("point"))
    if not rows.groupBy("file").count().where(F.col("count") > MOST_CELLS).isEmpty():
        raise ValueError(f"an inventory has at most {MOST_CELLS} cells")
    field = lambda name: F.coalesce(*(F.nullif(F.trim(F.try_element_at(F.col("tags"), F.lit(a))), F.lit("")) for a in ALIASES[name]))
    number = lambda name: field(name).try_cast("double")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    wanted = F.coalesce(field("id"), F.concat(F.lit("imported-"), F.col("place").cast("string")))
    rows = rows.withColumn("wanted", wanted).withColumn("wanted_cell", F.coalesce(field("cell_id"), F.col("wanted")))

    def unique(column: str):
        k = F.row_number().over(Window.partitionBy("file", column).orderBy("place"))
        return F.concat(column, F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""))

    lon, lat = F.coalesce(F.get("point", F.lit(0)), number("lon")), F.coalesce(F.get("point", F.lit(1)), number("lat"))
    problem = F.when(~F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False)), "invalid_coordinates").when((F.octet_length("wanted") > MOST_ID_BYTES) | (F.octet_length("wanted_cell") > MOST_ID_BYTES), "id_too_long")
    return rows.select(
        "place", unique("wanted").alias("id"), unique("wanted_cell").alias("cell_id"), lon.alias("lon"), lat.alias("lat"), F.lower(field("tech")).alias("tech"), *(number(n).alias(n) for n in ("ghz", "mhz", "power_dbm", "radius_m", "beam_deg", "azimuth")),
        F.coalesce(field("simulated").try_cast("boolean"), F.lit(False)).alias("simulated"), problem.alias("problem"), "file",
    )


def numbered(cells: DataFrame, key: str, order: str) -> DataFrame:
    """cells with ``number``: a positive whole ``key`` is kept by its first row in ``order``; the others get the smallest numbers
    that no row has, in order. The free numbers come from the gaps between used ones: as many ranges as gaps, not as numbers."""
    from meridia.operators.ordered import running

    rows = cells.withColumn("_n", positive_integer(F.col(key).cast("string")))
    first = rows.where("_n IS NOT NULL").groupBy("_n").agg(F.min(order).alias("_first"))
    marked = rows.join(first, "_n", "left").withColumn("_good", F.coalesce(F.col(order) == F.col("_first"), F.lit(False)))
    # the i-th free number is i plus the used numbers up to it: used number number k (from 1) has n - k free ones before it
    used = running(first.select("_n"), ["_n"], "_k").select((F.col("_n") - F.col("_k")).alias("_free"), "_k").groupBy("_free").agg(F.max("_k").alias("_k"))
    asks = running(marked.where("NOT _good").select(F.col(order).alias("_o")), ["_o"], "_i")
    every = asks.select(F.col("_i").alias("_at"), F.lit(1).alias("_ask"), "_o", F.lit(0).cast("long").alias("_k")).unionByName(used.select((F.col("_free") + 1).alias("_at"), F.lit(0).alias("_ask"), F.lit(None).cast(dict(cells.dtypes)[order]).alias("_o"), "_k"))
    # the used numbers that stand before the i-th free one: the largest k among used ones with fewer than i free numbers before them
    upto = F.max("_k").over(Window.partitionBy(F.lit(0)).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    given = every.withColumn("_given", F.col("_at") + upto).where("_ask = 1").select(F.col("_o").alias(order), "_given")  # an inventory: at most MOST_CELLS rows
    return marked.join(given, order, "left").withColumn("number", F.when(F.col("_good"), F.col("_n")).otherwise(F.col("_given"))).drop("_n", "_first", "_good", "_given")
