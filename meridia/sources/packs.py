"""Dataset packs: layers as Parquet folders with checksums and a manifest; catalogues of packs; checks of layers before they go in."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.sources import raster
from meridia.sources.geojson import rings

SCHEMA_VERSION = 2
#: Rows of a layer's file: bounds what a checksum task holds.
FILE_ROWS = 1_000_000


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _sums(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of each part file of a layer, made where the files are read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sum"))
    return {r.name: r["sum"] for r in rows.collect()}  # one row a file


def build_pack(spark: SparkSession, root: str, pack_id: str, layers: dict[str, DataFrame], about: dict[str, dict] | None = None) -> dict:
    """Write layers and a manifest to a new folder ``root``: first beside it, then renamed, so that a pack is whole or not there."""
    fs, target = _fs(spark, root)
    if fs.exists(target):
        raise FileExistsError(root)
    staging = f"{root.rstrip('/')}.staging-{uuid.uuid4().hex}"
    manifest: dict = {"schema_version": SCHEMA_VERSION, "id": pack_id, "files": {}}
    for name, df in layers.items():
        df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{staging}/{name}")
        manifest["files"][name] = {"path": name, "format": "parquet", "rows": spark.read.parquet(f"{staging}/{name}").count(), "parts": _sums(spark, f"{staging}/{name}"), **(about or {}).get(name, {})}
    out = fs.create(_fs(spark, f"{staging}/manifest.json")[1])
    out.write(json.dumps(manifest, indent=1, sort_keys=True).encode())
    out.close()
    if not fs.rename(_fs(spark, staging)[1], target):
        raise OSError(f"{staging} could not become {root}")
    return manifest


def load_pack(spark: SparkSession, root: str, views: bool = True) -> dict[str, DataFrame]:
    """The layers of a pack whose checksums hold, also as temporary views of their names."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{root.rstrip('/')}/manifest.json").collect()))  # one small file
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"schema_version must be {SCHEMA_VERSION}")
    out = {}
    for name, entry in manifest["files"].items():
        if entry["path"].startswith("/") or ".." in entry["path"].split("/") or ":" in entry["path"]:
            raise ValueError(f"{name} lies outside the pack")
        folder = f"{root.rstrip('/')}/{entry['path']}"
        if _sums(spark, folder) != entry["parts"]:
            raise ValueError(f"{name} has another checksum")
        out[name] = spark.read.parquet(folder)
        if views:
            out[name].createOrReplaceTempView(name)
    return out


def installed(spark: SparkSession, root: str) -> DataFrame:
    """(id, path) of the packs under a folder; an id that two packs have names neither."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(root, schema="id string", multiLine=True).select("id", F.regexp_replace(F.input_file_name(), "/manifest.json$", "").alias("path"))
    return found.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")


def repaired(ring: Column) -> Column:
    """(ring, status) of a ring: vertices that repeat the one before are dropped; fewer than three are no polygon; edges that cross
    are named, not mended."""
    n = F.size(ring)
    tidy = F.filter(ring, lambda v, i: (i == 0) | (v != F.element_at(ring, F.greatest(i, F.lit(1)).cast("int"))))
    e = geo.edges(tidy)
    side = lambda p, q, r: (q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"])

    def crosses(a: Column, b: Column) -> Column:
        p, q, r, s = (F.struct(x[f"{k}x"].alias("lon"), x[f"{k}y"].alias("lat")) for x, k in ((a, "a"), (a, "b"), (b, "a"), (b, "b")))
        return (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)

    self_crossing = F.exists(e, lambda a: F.exists(e, lambda b: crosses(a, b)))
    status = F.when(ring.isNull() | (n == 0), "empty_geometry").when(F.size(F.array_distinct(tidy)) < 3, "invalid_geometry").when(self_crossing, "self_intersection").when(F.size(tidy) < n, "repaired_geometry").otherwise("valid")
    return F.struct(F.when(status.isin("valid", "repaired_geometry"), tidy).alias("ring"), status.alias("status"))


def prepared(features: DataFrame, bounds: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """A vector layer (id, kind, coordinates, ...) as polygon parts that stand, and counts of all parts by status."""
    parts = features.withColumn("_rings", F.when(F.col("kind").isin("Polygon", "MultiPolygon"), rings(F.col("kind"), F.col("coordinates"))))
    p = parts.withColumn("_ring", F.explode_outer("_rings")).withColumn("_r", repaired(F.col("_ring")))
    outside = F.lit(False)
    if bounds:
        west, south, east, north = bounds
        x, y = F.transform("_r.ring", lambda v: v["lon"]), F.transform("_r.ring", lambda v: v["lat"])
        outside = (F.array_max(x) < west) | (F.array_min(x) > east) | (F.array_max(y) < south) | (F.array_min(y) > north)
    status = F.when(~F.col("kind").isin("Polygon", "MultiPolygon"), "unsupported_geometry").when(F.coalesce(outside, F.lit(False)), "outside").otherwise(F.col("_r.status"))
    p = p.withColumn("status", status)
    good = p.where(F.col("status").isin("valid", "repaired_geometry")).withColumn("ring", F.col("_r.ring")).drop("_rings", "_ring", "_r", "coordinates")
    return good, p.groupBy("status").agg(F.count("*").alias("n"))


def scan_tiles(spark: SparkSession, path: str, bounds: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Footprints of tiles with one feature a line (gzip too): (tile, id, ring, height_m) of the good ones inside, each once, and
    counts (tile, code, n) of what happened to every line. A gzip tile is one task, as it can't be split."""
    raw = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.[a-z]+)*$", 1).alias("tile"), "value")
    one = F.from_json("value", "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>")
    f = raw.withColumn("f", one).withColumn("parsed", F.expr("try_parse_json(value)").isNotNull() & F.col("f.type").isNotNull())
    ring = F.get(rings(F.col("f.geometry.type"), F.col("f.geometry.coordinates")), F.lit(0))
    f = f.withColumn("r", repaired(ring)).withColumn("height_m", F.try_element_at("f.properties", F.lit("height")).try_cast("double"))
    west, south, east, north = bounds
    x, y = F.transform("r.ring", lambda v: v["lon"]), F.transform("r.ring", lambda v: v["lat"])
    outside = (F.array_max(x) < west) | (F.array_min(x) > east) | (F.array_max(y) < south) | (F.array_min(y) > north)
    code = (
        F.when(~F.col("parsed"), "invalid_json").when(~F.coalesce(F.col("f.geometry.type").isin("Polygon", "MultiPolygon"), F.lit(False)), "unsupported_geometry")
        .when(F.col("r.ring").isNull(), F.col("r.status")).when(outside, "out_of_aoi").when(F.col("height_m").isNull(), "missing_height").when(F.col("height_m") <= 0, "nonpositive_height")
    )
    shape = F.xxhash64("r.ring", "f.geometry.coordinates")
    f = f.withColumn("code", code).withColumn("id", F.coalesce("f.id", F.concat("tile", F.lit("-"), F.hex(F.xxhash64("value"))))).withColumn("shape", shape)
    live = f.where("code IS NULL").select("tile", "id", "shape", F.col("r.ring").alias("ring"), "height_m", F.xxhash64("tile", "value").alias("line"))
    # of lines with one id the first stays, then of equal shapes the first: aggregations, so a shape that many lines have is no hot task
    by_id = live.groupBy("id").agg(F.min(F.struct("tile", "line", "shape", "ring", "height_m")).alias("k"), F.count("*").alias("n"))
    by_shape = by_id.groupBy("k.shape").agg(F.min(F.struct("k.tile", "id", "k.ring", "k.height_m")).alias("s"), F.count("*").alias("n"))
    every = f.groupBy("tile", F.coalesce("code", F.lit("kept_or_duplicate")).alias("code")).agg(F.count("*").alias("n"))
    twice = by_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit(None).cast("string").alias("tile"), F.lit("duplicate_id").alias("code"), "n")
    same = by_shape.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit(None).cast("string").alias("tile"), F.lit("duplicate_geometry").alias("code"), "n")
    return by_shape.select("s.*"), every.unionByName(twice).unionByName(same)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """(tile, width, height, west, north, step_x, step_y, valid, least, most) of rasters, without their pixels."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part["path"], part["content"]):
                z, (west, north, dx, dy) = raster.read_geotiff(raw)
                known = z[z == z]
                yield pd.DataFrame([(name.rsplit("/", 1)[-1], z.shape[1], z.shape[0], west, north, dx, dy, len(known), known.min() if len(known) else None, known.max() if len(known) else None)], columns=["tile", "width", "height", "west", "north", "step_x", "step_y", "valid", "least", "most"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(look, "tile string, width long, height long, west double, north double, step_x double, step_y double, valid long, least double, most double")
