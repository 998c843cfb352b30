"""Deterministic spatial views over the driver's tables, once as DataFrames and once as DuckDB SQL, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEST, SOUTH, SIDE = 32.8, 39.9, 0.2


def _place(k: Column, a: int, m: int) -> Column:
    return F.pmod(k * a, F.lit(m)) / float(m) * SIDE


def _place_sql(k: str, a: int, m: int) -> str:
    return f"({k} * {a} % {m}) / {float(m)} * {SIDE}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    five = F.col("s_nationkey") % 2 == 0
    return table(spark, sf_dir, "supplier").select(
        k.alias("cell_id"), (WEST + _place(k, 7919, 1000)).alias("lon"), (SOUTH + _place(k, 104729, 1009)).alias("lat"), (k * 37 % 360).cast("double").alias("azimuth"),
        F.when(five, "5g").otherwise("4g").alias("tech"), F.when(five, 28.0).otherwise(2.6).alias("ghz"), F.when(five, 100.0).otherwise(20.0).alias("mhz"),
        (400.0 + 100 * (k % 5)).alias("radius_m"), F.concat(F.lit("CH-"), (k % 3 + 1).cast("string")).alias("channel"), (0.5 + (k % 5) / 10.0).alias("load"),
    )


CELLS = f"""lens_cells AS (SELECT s_suppkey AS cell_id, {WEST} + {_place_sql('s_suppkey', 7919, 1000)} AS lon, {SOUTH} + {_place_sql('s_suppkey', 104729, 1009)} AS lat, (s_suppkey * 37 % 360)::DOUBLE AS azimuth,
 CASE WHEN s_nationkey % 2 = 0 THEN '5g' ELSE '4g' END AS tech, CASE WHEN s_nationkey % 2 = 0 THEN 28.0::DOUBLE ELSE 2.6::DOUBLE END AS ghz, CASE WHEN s_nationkey % 2 = 0 THEN 100.0::DOUBLE ELSE 20.0::DOUBLE END AS mhz,
 400.0::DOUBLE + 100 * (s_suppkey % 5) AS radius_m, 'CH-' || (s_suppkey % 3 + 1) AS channel, 0.5::DOUBLE + (s_suppkey % 5) / 10.0::DOUBLE AS load FROM supplier)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, cents = F.col("o_orderkey"), F.floor(F.col("o_totalprice") * 100 + 0.5)
    return table(spark, sf_dir, "orders").select(
        k.alias("sample_id"), (WEST + _place(k, 7907, 10007)).alias("lon"), (SOUTH + _place(k, 6011, 9973)).alias("lat"), F.col("o_custkey").alias("cell_id"), (F.col("o_custkey") % 50).alias("site_id"),
        F.year("o_orderdate").cast("long").alias("campaign"), F.col("o_orderpriority").alias("class"), (-140.0 + (cents % 8000) / 100.0).alias("rsrp"), ((cents % 4001) / 100.0 - 20.0 + F.when(k % 97 == 0, 60.0).otherwise(0.0)).alias("residual"), (cents % 1500).cast("double").alias("distance_m"), (k % 5).alias("walls"),
        F.when(k % 2 == 0, 28.0).otherwise(2.6).alias("ghz"), F.when(k % 3 == 0, "los").when(k % 3 == 1, "nlos").otherwise("unknown").alias("los"),
    )


_CENTS = "floor(o_totalprice * 100 + 0.5)::BIGINT"
SAMPLES = f"""lens_samples AS (SELECT o_orderkey AS sample_id, {WEST} + {_place_sql('o_orderkey', 7907, 10007)} AS lon, {SOUTH} + {_place_sql('o_orderkey', 6011, 9973)} AS lat, o_custkey AS cell_id, o_custkey % 50 AS site_id,
 year(o_orderdate)::BIGINT AS campaign, o_orderpriority AS class, -140.0::DOUBLE + ({_CENTS} % 8000) / 100.0::DOUBLE AS rsrp, ({_CENTS} % 4001) / 100.0::DOUBLE - 20.0 + CASE WHEN o_orderkey % 97 = 0 THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END AS residual, ({_CENTS} % 1500)::DOUBLE AS distance_m, o_orderkey % 5 AS walls,
 CASE WHEN o_orderkey % 2 = 0 THEN 28.0::DOUBLE ELSE 2.6::DOUBLE END AS ghz, CASE o_orderkey % 3 WHEN 0 THEN 'los' WHEN 1 THEN 'nlos' ELSE 'unknown' END AS los FROM orders)"""

_KINDS = ("yes", "apartments", "commercial", "house", "hospital", "No", "retail")
_MATERIAL = ("", "Red Brick", "steel frame", "reinforced concrete", "timber", "glass curtain")


def _pick(values, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _pick_sql(values, k: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{k} % {len(values)} + 1]"


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular footprints with tags; ``ring`` is the open outer ring."""
    k = F.col("c_custkey")
    half = (10 + k % 21) / 111320.0
    b = table(spark, sf_dir, "customer").select(
        k.alias("building_id"), (WEST + _place(k, 6007, 9001)).alias("lon"), (SOUTH + _place(k, 7001, 9007)).alias("lat"), half.alias("half"), _pick(_KINDS, k).alias("building"), _pick(_MATERIAL, k).alias("material_tag"),
        F.when(k % 3 == 1, F.concat((3 + k % 40).cast("string"), F.lit(" m"))).when(k % 3 == 2, F.concat((10 + k % 90).cast("string"), F.lit("ft"))).alias("height_tag"), F.when(k % 7 == 0, (k % 12).cast("string")).alias("levels_tag"),
        F.when(k % 11 == 0, "cafe").when(k % 13 == 0, "clinic").alias("amenity"), F.when(k % 17 == 0, "Mall").alias("shop"), F.when(k % 19 == 0, "bank").alias("office"), F.concat(F.lower("c_mktsegment"), F.when(k % 23 == 0, " tower").otherwise("")).alias("name"),
        (400.0 * (10 + k % 21)).alias("area_m2"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("demand"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", 10.0 + k % 30).otherwise(0.0).alias("residential"), F.upper(F.col("c_mktsegment")).alias("segment"),
    )
    corner = lambda x, y: F.struct((F.col("lon") + x * F.col("half")).alias("lon"), (F.col("lat") + y * F.col("half")).alias("lat"))
    return b.withColumn("ring", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))


BUILDINGS = f"""lens_buildings AS (SELECT c_custkey AS building_id, {WEST} + {_place_sql('c_custkey', 6007, 9001)} AS lon, {SOUTH} + {_place_sql('c_custkey', 7001, 9007)} AS lat, (10 + c_custkey % 21) / 111320.0::DOUBLE AS half,
 {_pick_sql(_KINDS, 'c_custkey')} AS building, {_pick_sql(_MATERIAL, 'c_custkey')} AS material_tag,
 CASE c_custkey % 3 WHEN 1 THEN (3 + c_custkey % 40) || ' m' WHEN 2 THEN (10 + c_custkey % 90) || 'ft' END AS height_tag, CASE WHEN c_custkey % 7 = 0 THEN (c_custkey % 12)::VARCHAR END AS levels_tag,
 CASE WHEN c_custkey % 11 = 0 THEN 'cafe' WHEN c_custkey % 13 = 0 THEN 'clinic' END AS amenity, CASE WHEN c_custkey % 17 = 0 THEN 'Mall' END AS shop, CASE WHEN c_custkey % 19 = 0 THEN 'bank' END AS office,
 lower(c_mktsegment) || CASE WHEN c_custkey % 23 = 0 THEN ' tower' ELSE '' END AS name, 400.0::DOUBLE * (10 + c_custkey % 21) AS area_m2, greatest(c_acctbal, 0.0::DOUBLE) AS demand,
 CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 10.0::DOUBLE + c_custkey % 30 ELSE 0.0::DOUBLE END AS residential, upper(c_mktsegment) AS segment FROM customer)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collector log: rows of a session in file order, with a position now and then."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("line"), F.col("user_id").alias("session"), "ts", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("epoch_ms"), F.col("event_type").alias("source"), "value",
        F.when(k % 4 == 0, WEST + _place(k, 3001, 5003)).alias("fix_lon"), F.when(k % 7 == 0, F.concat(F.lit("P"), (k % 20).cast("string"))).alias("point"), (k * 977 % 100000).alias("elapsed_ns"),
    )


LOG = f"""lens_log AS (SELECT event_id AS line, user_id AS session, ts, epoch_ms(ts) AS epoch_ms, event_type AS source, value, CASE WHEN event_id % 4 = 0 THEN {WEST} + {_place_sql('event_id', 3001, 5003)} END AS fix_lon,
 CASE WHEN event_id % 7 = 0 THEN 'P' || (event_id % 20) END AS point, event_id * 977 % 100000 AS elapsed_ns FROM events)"""
