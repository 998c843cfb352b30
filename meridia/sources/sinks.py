"""Tables as GeoJSON lines, CSV with WKT, and rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def wkt(ring: Column) -> Column:
    points = F.transform(closed(ring), lambda v: F.concat_ws(" ", v["lon"].cast("string"), v["lat"].cast("string")))
    return F.when(F.size(ring) == 0, "POLYGON EMPTY").otherwise(F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))")))


def feature_lines(df: DataFrame, ring: str, properties: list[str], key: str = "id") -> DataFrame:
    """One column ``value``: a GeoJSON polygon feature a row; not-a-number becomes null."""
    plain = {c: F.when(F.isnan(c), None).otherwise(F.col(c)) if t in ("double", "float") else F.col(c) for c, t in df.dtypes}
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed(F.col(ring)), lambda v: F.array(v["lon"], v["lat"]))).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(key).cast("string").alias("id"), F.struct(*(plain[p].alias(p) for p in properties)).alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))


def point_lines(df: DataFrame, lon: str, lat: str, properties: list[str], key: Column) -> DataFrame:
    shape = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), key.alias("id"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("value"))


def building_csv(df: DataFrame, ring: str, columns: list[str]) -> DataFrame:
    """Columns for write.csv(header=True), the ring as WKT after the first."""
    return df.select(columns[0], wkt(F.col(ring)).alias("geometry_wkt"), *columns[1:])


def surface_csv(df: DataFrame) -> DataFrame:
    """lon and lat with 7 decimals, dBm with 1; cells without data are left out."""
    return df.where("dbm IS NOT NULL").select(F.format_string("%.7f", "lon").alias("lon"), F.format_string("%.7f", "lat").alias("lat"), F.format_string("%.1f", "dbm").alias("dbm"))
