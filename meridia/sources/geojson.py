"""GeoJSON feature collections as building, tower and height tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import tags

_FEATURE = "struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
_COLLECTION = f"type string, features array<{_FEATURE}>"


def features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(index, id, tags, kind, coordinates): features of a collection, or of a file with one feature a line (splittable, for
    large data). Property names and texts are lower-cased; coordinates stay JSON text."""
    if lines:
        one = spark.read.schema("type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>").json(path)
        rows = one.where("type = 'Feature'").select(F.monotonically_increasing_id().alias("index"), "id", "properties", "geometry")
    else:
        whole = spark.read.schema(_COLLECTION).json(path, multiLine=True).where("type = 'FeatureCollection'")
        rows = whole.select(F.posexplode("features").alias("index", "f")).select("index", "f.id", "f.properties", "f.geometry")
    low = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    name = F.coalesce("id", F.concat(F.lit("feature-"), F.col("index").cast("string")))
    return rows.select("index", name.alias("id"), low.alias("tags"), F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"))


def rings(kind: Column, coordinates: Column) -> Column:
    """Outer rings (holes are left out) as arrays of structs (lon, lat), without the closing vertex."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    outer = F.when(kind == "Polygon", F.array(F.try_element_at(polygon, F.lit(1)))).when(kind == "MultiPolygon", F.transform(many, lambda p: F.try_element_at(p, F.lit(1))))

    def opened(ring: Column) -> Column:
        good = F.transform(F.filter(ring, lambda c: F.size(c) >= 2), lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat")))
        n = F.size(good)
        closed = (n > 1) & (F.try_element_at(good, F.lit(1)) == F.try_element_at(good, F.lit(-1)))
        return F.when(closed, F.slice(good, F.lit(1), n - 1)).otherwise(good)

    return F.filter(F.transform(F.filter(outer, lambda r: r.isNotNull()), opened), lambda r: F.size(r) >= 3)


def buildings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each polygon part: ids (``-k`` for parts), heights with evidence, material, clamped scores, ring, bounds."""
    f = features(spark, path, lines).withColumn("parts", rings(F.col("kind"), F.col("coordinates"))).where(F.size("parts") > 0)
    p = f.select("id", "tags", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "ring"))
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    number = lambda k: F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan(tag(k).try_cast("double")), tag(k).try_cast("double")), F.lit(0.0)))
    h = tags.height(tag("height"), tag("building:levels"))
    weight = F.when(number("weight") > 0, number("weight")).otherwise(1.0)
    edge = lambda f, k: f(F.transform("ring", lambda v: v[k]))
    return p.select(
        F.when(F.col("n") > 1, F.concat("id", F.lit("-"), F.col("k").cast("string"))).otherwise(F.col("id")).alias("id"), F.col("id").alias("logical_id"), "tags", h["height_m"].alias("height_m"), h["evidence"].alias("evidence"),
        tags.material(tag("building:material"), tag("material"), tag("facade:material")).alias("material"), weight.alias("weight"), number("demand_weight").alias("demand_weight"), number("residential_demand").alias("residential_demand"), number("density_score").alias("density_score"),
        "ring", edge(F.array_min, "lon").alias("min_lon"), edge(F.array_min, "lat").alias("min_lat"), edge(F.array_max, "lon").alias("max_lon"), edge(F.array_max, "lat").alias("max_lat"),
    )


def towers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Point features as cells; properties that are missing default to 0, "" and false."""
    f = features(spark, path, lines).where("kind = 'Point'").withColumn("c", F.from_json("coordinates", "array<double>")).where(F.size("c") >= 2)
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    return f.select("id", F.coalesce(tag("cell_id").try_cast("long"), tag("cell").try_cast("long"), F.lit(0)).alias("cell_id"), F.coalesce(tag("radio"), tag("radio_type"), F.lit("")).alias("radio_type"), F.coalesce(tag("is_simulated_5g").try_cast("boolean"), F.lit(False)).alias("is_simulated"), F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))


def external_heights(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Footprints with a height between 0 and 500 m from another source."""
    f = features(spark, path, lines).withColumn("parts", rings(F.col("kind"), F.col("coordinates"))).where(F.size("parts") > 0)
    h = F.try_element_at(F.col("tags"), F.lit("height")).try_cast("double")
    return f.select("id", F.element_at("parts", 1).alias("ring"), h.alias("height_m"), F.coalesce(F.try_element_at(F.col("tags"), F.lit("source")), F.lit("external")).alias("source")).where("height_m > 0 AND height_m <= 500")
