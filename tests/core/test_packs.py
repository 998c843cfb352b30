"""Inventories, packs, tile scans and probes on small files."""

import gzip
import json

import numpy as np
import pytest

from meridia.sources import inventory, packs, raster

SQUARE = [[32.85, 39.92], [32.86, 39.92], [32.86, 39.93], [32.85, 39.93], [32.85, 39.92]]
BOW = [[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]


def test_inventory_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Longitude,lat,network_tech,frequency_ghz\na,32.8,39.9,5G,28\na,32.9,39.9,4g,x\n,32.8,39.9,,\nb,200,1,,\n" + "y" * 129 + ",1,1,,\n")
    got = [tuple(r[k] for k in ("place", "id", "cell_id", "tech", "ghz", "problem")) for r in inventory.inventory(spark, str(tmp_path / "a.csv")).orderBy("place").collect()]
    assert got[:4] == [(1, "a", "a", "5g", 28.0, None), (2, "a-2", "a-2", "4g", None, None), (3, "imported-3", "imported-3", None, None, None), (4, "b", "b", None, None, "invalid_coordinates")] and got[4][5] == "id_too_long"
    fs = [{"type": "Feature", "properties": {"cellId": "c1", "is_simulated": True}, "geometry": {"type": "Point", "coordinates": [32.8, 39.9]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    r = inventory.inventory(spark, str(tmp_path / "a.geojson")).collect()
    assert [(x.cell_id, x.lon, x.lat, x.simulated, x.problem) for x in r] == [("c1", 32.8, 39.9, True, None)]


def test_smallest_free_numbers(spark):
    keys = ["5", "2", "2", None, "x", "1", "-3", "7.0", "0"]
    df = spark.createDataFrame(list(enumerate(keys)), "i long, k string")
    assert [r.number for r in inventory.numbered(df, "k", "i").orderBy("i").collect()] == [5, 2, 3, 4, 6, 1, 8, 7, 9]


def test_packs(spark, tmp_path):
    root = str(tmp_path / "packs" / "one")
    layers = {"cells": spark.range(5).withColumnRenamed("id", "cell_id"), "sites": spark.range(3)}
    packs.build_pack(spark, root, "ankara", layers, {"cells": {"units": "m"}})
    got = packs.load_pack(spark, root)
    assert got["cells"].count() == 5 and spark.sql("SELECT count(*) FROM sites").first()[0] == 3
    with pytest.raises(FileExistsError):
        packs.build_pack(spark, root, "ankara", layers)
    packs.build_pack(spark, str(tmp_path / "packs" / "two"), "izmir", {"cells": spark.range(1)})
    assert [(r.id, r.path.rsplit("/", 1)[-1]) for r in packs.installed(spark, str(tmp_path / "packs")).orderBy("id").collect()] == [("ankara", "one"), ("izmir", "two")]
    packs.build_pack(spark, str(tmp_path / "packs" / "three"), "izmir", {"cells": spark.range(1)})
    assert [r.id for r in packs.installed(spark, str(tmp_path / "packs")).collect()] == ["ankara"]
    part = next((tmp_path / "packs" / "one" / "cells").glob("*.parquet"))
    spark.range(9).coalesce(1).write.parquet(str(tmp_path / "other"))
    part.write_bytes(next((tmp_path / "other").glob("*.parquet")).read_bytes())
    (part.parent / f".{part.name}.crc").unlink()  # the local file system's own sum
    with pytest.raises(ValueError, match="checksum"):
        packs.load_pack(spark, root)


def test_layers_and_tiles(spark, tmp_path):
    rows = [("a", "Polygon", json.dumps([SQUARE])), ("b", "Polygon", json.dumps([[SQUARE[0], SQUARE[0], *SQUARE[1:]]])), ("c", "Polygon", json.dumps([BOW])), ("d", "Point", "[1,2]"), ("e", "Polygon", json.dumps([[[5, 5], [5, 5], [5, 5], [5, 5]]])), ("f", "Polygon", json.dumps([[[x + 9, y] for x, y in SQUARE]]))]
    good, counts = packs.prepared(spark.createDataFrame(rows, "id string, kind string, coordinates string"), (32, 39, 33, 40))
    assert {r.id: len(r.ring) for r in good.collect()} == {"a": 4, "b": 4}
    assert {r.status: r.n for r in counts.collect()} == {"valid": 1, "repaired_geometry": 1, "self_intersection": 1, "unsupported_geometry": 1, "invalid_geometry": 1, "outside": 1}
    feature = lambda i, ring, h: json.dumps({"type": "Feature", "id": i, "properties": {} if h is None else {"height": h}, "geometry": {"type": "Polygon", "coordinates": [ring]}})
    lines = [feature("1", SQUARE, 12), feature("1", SQUARE, 12), feature("2", SQUARE, 12), feature("3", [[x + 0.1, y] for x, y in SQUARE], None), feature("4", [[x + 9, y] for x, y in SQUARE], 5), feature("5", [[x - 0.1, y] for x, y in SQUARE], -1), "{bad", feature("6", BOW, 3)]
    with gzip.open(tmp_path / "t1.csv.gz", "wt") as f:
        f.write("\n".join(lines))
    kept, counts = packs.scan_tiles(spark, str(tmp_path / "t1.csv.gz"), (32, 39, 33, 40))
    assert [(r.tile, r.id, r.height_m) for r in kept.collect()] == [("t1", "1", 12.0)]
    assert {r.code: r.n for r in counts.collect()} == {"kept_or_duplicate": 3, "missing_height": 1, "out_of_aoi": 1, "nonpositive_height": 1, "invalid_json": 1, "self_intersection": 1, "duplicate_id": 1, "duplicate_geometry": 1}


def test_raster_probe(spark, tmp_path):
    z = np.array([[1.0, 2.0, 3.0], [4.0, np.nan, 6.0]])
    (tmp_path / "a.tif").write_bytes(raster.write_geotiff(np.where(np.isnan(z), -9999.0, z), 32.0, 40.0, 0.1, 0.1))
    r = packs.probe(spark, str(tmp_path / "a.tif")).first()
    assert (r.width, r.height, r.valid, r.least, r.most) == (3, 2, 5, 1.0, 6.0)
