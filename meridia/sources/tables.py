"""Measurement and inventory files, tower exports, dataset packs."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Other names of measurement columns, and the columns of a tower export without a header.
ALIASES = {"longitude": "lon", "latitude": "lat", "rsrp": "rsrp_dbm"}
REQUIRED = ("id", "lon", "lat", "technology", "rsrp_dbm")
TOWER_COLUMNS = ("radio", "mcc", "net", "area", "cell", "unit", "lon", "lat", "range", "samples", "changeable", "created", "updated")


def measurements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid samples, and the others with the first rule they break; ids must be unique."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [ALIASES.get(c.strip().lower(), c.strip().lower()) for c in raw.columns]
    if len(set(names)) != len(names):
        raise ValueError("two columns have one name")
    if missing := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df = raw.toDF(*names)
    lon, lat, rsrp = (F.col(c).try_cast("double") for c in ("lon", "lat", "rsrp_dbm"))
    tech = F.lower("technology")
    broken = (
        F.when(F.coalesce("id", F.lit("")) == "", "empty_id").when(F.count("*").over(Window.partitionBy("id")) > 1, "duplicate_id").when(~F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False)), "invalid_coordinates")
        .when(~F.coalesce(rsrp.between(-180, -20), F.lit(False)), "invalid_rsrp").when(~F.coalesce(tech.isin("4g", "5g"), F.lit(False)), "invalid_technology")
    )
    cell = F.nullif("cell_id", F.lit("")) if "cell_id" in names else F.lit(None).cast("string")
    df = df.withColumn("broken", broken)
    good = df.where("broken IS NULL").select("id", lon.alias("lon"), lat.alias("lat"), tech.alias("technology"), rsrp.alias("rsrp_dbm"), cell.alias("cell_id"))
    return good, df.where("broken IS NOT NULL").select("id", "broken")


def tower_export(spark: SparkSession, path: str, bounds: tuple[float, float, float, float], few: int = 50) -> DataFrame:
    """Cells of a box from a CSV with or without a header: 5G ones, and 4G ones as simulated where there are few; of rows with equal keys the one with most samples."""
    first = spark.read.text(path).first()
    header = bool(first) and "radio" in first.value.split(",")
    df = spark.read.csv(path, header=True) if header else spark.read.csv(path).toDF(*TOWER_COLUMNS)
    lon, lat = F.col("lon").try_cast("double"), F.col("lat").try_cast("double")
    df = df.withColumns({"lon": lon, "lat": lat}).where(F.col("lon").between(bounds[0], bounds[2]) & F.col("lat").between(bounds[1], bounds[3]))
    nr, lte = df.where("radio = 'NR'").withColumn("is_simulated_5g", F.lit(False)), df.where("radio = 'LTE'").withColumn("is_simulated_5g", F.lit(True))
    few_nr = nr.agg((F.count("*") < few).alias("few"))
    both = nr.unionByName(lte.join(few_nr).where("few").drop("few"))
    keys = ["radio", "mcc", "net", "area", "cell", "lon", "lat"]
    first_row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.col("samples").try_cast("long")), "created", "updated"))
    return both.withColumn("_r", first_row).where("_r = 1").drop("_r")


def pack(root: str) -> dict:
    """The manifest of a dataset pack on a local path, checked: version, paths inside the pack, SHA-256 of each layer."""
    with open(os.path.join(root, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    if manifest.get("schema_version") not in (1, 2):
        raise ValueError("schema_version must be 1 or 2")
    top = os.path.realpath(root)
    for name, entry in (manifest.get("files") or {}).items():
        entry = {"path": entry} if isinstance(entry, str) else entry
        at = os.path.realpath(os.path.join(top, entry["path"]))
        if os.path.commonpath([top, at]) != top:
            raise ValueError(f"{name} lies outside the pack")
        if entry.get("sha256"):
            digest = hashlib.sha256()
            with open(at, "rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            if digest.hexdigest() != entry["sha256"]:
                raise ValueError(f"{name} has another checksum")
    return manifest
