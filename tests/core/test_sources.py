"""Readers, writers and streams on small files."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.plans import lens, logs
from meridia.sources import collector, geojson, raster, sinks, tables
from meridia.streaming import windows

SF = "/root/testdata/sf0.001"
SQUARE = [[32.85, 39.92], [32.86, 39.92], [32.86, 39.93], [32.85, 39.93], [32.85, 39.92]]


def test_geojson(spark, tmp_path):
    fs = [
        {"type": "Feature", "id": "b1", "properties": {"Building": "apartments", "height": "12 m", "demand_weight": -3, "weight": 0}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, [[32.852, 39.922], [32.853, 39.922], [32.853, 39.923]]]}},
        {"type": "Feature", "properties": {"building:levels": "4"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [[[x + 1, y] for x, y in SQUARE]]]}},
        {"type": "Feature", "id": "t", "properties": {"cell": 7, "radio": "NR"}, "geometry": {"type": "Point", "coordinates": [32.8, 39.9]}},
    ]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, fs)))
    b = {r.id: r for r in geojson.buildings(spark, str(tmp_path / "f.geojson")).collect()}
    assert set(b) == {"b1", "feature-1-0", "feature-1-1"} and b["feature-1-1"].logical_id == "feature-1"
    assert (b["b1"].height_m, b["b1"].demand_weight, b["b1"].weight, len(b["b1"].ring)) == (12.0, 0.0, 1.0, 4)
    assert (b["feature-1-0"].height_m, b["feature-1-0"].evidence) == (12.0, "derived_from_levels")
    assert geojson.buildings(spark, str(tmp_path / "f.jsonl"), lines=True).count() == 3
    t = geojson.towers(spark, str(tmp_path / "f.geojson")).first()
    assert (t.cell_id, t.radio_type, t.is_simulated, t.lon) == (7, "NR", False, 32.8)
    assert geojson.external_heights(spark, str(tmp_path / "f.geojson")).count() == 0
    df = geojson.buildings(spark, str(tmp_path / "f.geojson"))
    line = json.loads(sinks.feature_lines(df.where("id = 'b1'"), "ring", ["height_m", "material"]).first().value)
    assert line["geometry"]["coordinates"][0] == SQUARE and line["properties"]["height_m"] == 12.0
    assert sinks.building_csv(df.where("id = 'b1'"), "ring", ["id", "height_m"]).first().geometry_wkt.startswith("POLYGON ((32.85 39.92, ")


def test_collector(spark, tmp_path):
    head = "\n".join(["SIGNAL_COLLECTOR_TXT_V6", "export_id=x", "record_count=2", "", "\t".join(collector.COLUMNS)])
    rows = ["2026-10-02T10:00:00Z\t1790935200000\t100\ts\t1\tlocation\trecord_type=fix;note=a\\;b\\=c\\\\n;note2=x\\ty", "2026-10-02T10:00:09Z\t1790935200000\t90\ts\t2\tcell\tk=1;k=2;", "bad\trow", "2026-10-02T10:00:00Z\tx\t1\ts\t3\tcell\tk=1", "never\t1\t1\ts\t3\tcell\tk=1", "2026-10-02T10:00:00Z\t1790935200000\t1\ts\t4\tcell\tk\\q=1"]
    (tmp_path / "a.txt").write_text(head + "\n" + "\r\n".join(rows))
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write(head + "\n" + rows[0])
    good, issues, header = collector.parse(collector.lines_of(spark, str(tmp_path / "*.txt*")))
    by = {(r.file[-6:], r.line): r for r in good.collect()}
    assert len(by) == 3 and by["/a.txt", 6].payload == {"record_type": "fix", "note": "a;b=c\\n", "note2": "x\ty"} and by["/a.txt", 7].payload == {"k": "2"}
    assert {(r.line, r.code) for r in issues.collect()} == {(7, "timestamp_epoch_mismatch"), (8, "malformed_row"), (9, "invalid_timestamp_or_sequence"), (10, "invalid_timestamp"), (11, "malformed_payload")}
    assert {(r.key, r.value) for r in header.collect()} == {("export_id", "x"), ("record_count", "2")}


def test_measurement_and_tower_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ID,Longitude,lat,technology,rsrp\na,32.8,39.9,5G,-90\nb,32.8,99,4g,-90\nc,32.8,39,4g,-10\nd,32.8,39,3g,-90\ne,1,1,4g,-90\ne,1,1,4g,-90\n")
    good, bad = tables.measurements(spark, str(tmp_path / "m.csv"))
    assert [tuple(r)[:5] for r in good.collect()] == [("a", 32.8, 39.9, "5g", -90.0)]
    assert sorted((r.id, r.broken) for r in bad.collect()) == [("b", "invalid_coordinates"), ("c", "invalid_rsrp"), ("d", "invalid_technology"), ("e", "duplicate_id"), ("e", "duplicate_id")]
    (tmp_path / "bad.csv").write_text("id,lon\n1,2\n")
    with pytest.raises(ValueError):
        tables.measurements(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "t.csv").write_text("NR,286,1,1,10,0,32.8,39.9,0,5,1,0,0\nNR,286,1,1,10,0,32.8,39.9,0,9,1,0,0\nLTE,286,1,1,11,0,32.8,39.9,0,5,1,0,0\nLTE,286,1,1,12,0,10,39.9,0,5,1,0,0\n")
    t = tables.tower_export(spark, str(tmp_path / "t.csv"), (32.5, 39.7, 33.0, 40.1)).collect()
    assert sorted((r.cell, r.is_simulated_5g, r.samples) for r in t) == [("10", False, "9"), ("11", True, "5")]


def test_rasters(spark, tmp_path):
    z = np.full((1201, 1201), 7, ">i2")
    z[0, 0], z[1200, 3] = -32768, 9
    (tmp_path / "N39E032.hgt").write_bytes(z.tobytes())
    r = raster.hgt(spark, str(tmp_path / "N39E032.hgt"))
    assert (r.count(), r.where("z IS NULL").count()) == (1201 * 1201, 1)
    assert tuple(r.where("z = 9").select("row", "col", "lat").first()) == (1200, 3, 39.0)
    grid = np.array([[1.5, np.nan, 3.0], [4.0, 5.0, 6.0]])
    (tmp_path / "g.tif").write_bytes(raster.write_geotiff(grid, 32.0, 40.0, 0.5, 0.25))
    back, at = raster.read_geotiff((tmp_path / "g.tif").read_bytes())
    assert np.array_equal(back, grid, equal_nan=True) and at == (32.0, 40.0, 0.5, 0.25)
    assert raster.geotiff(spark, str(tmp_path / "g.tif")).where("z = 6").first().lon == 33.25


def run_stream(df, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql("SELECT * FROM out").collect()


def test_streams_agree_with_batches(spark, tmp_path):
    log = lens.log(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    log.repartition(1).sortWithinPartitions("line").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = {(r.session, r.began.replace(tzinfo=None), r.n) for r in run_stream(windows.request_budget(stream, "session", "ts", "1 hour", 2), "complete")}
    want = {(r.session, r.window_start, r.n) for r in logs.tumbling_budget(spark, SF).collect()}
    assert {(s, n) for s, _, n in got} == {(s, n) for s, _, n in want} and len(got) == len(want)
    state = {r.line: (None if r.lon is None else round(r.lon, 7), r.point) for r in run_stream(windows.replay(stream.select("session", "line", "epoch_ms", "elapsed_ns", "fix_lon", "point")))}
    position = {r.line: r.lon for r in logs.locf_position(spark, SF).collect()}
    point = {r.line: r.point for r in logs.interval_point_state(spark, SF).collect()}
    assert state == {k: (position[k], point[k]) for k in position}
    timed = stream.select("session", "line", F.expr("timestampdiff(MICROSECOND, TIMESTAMP '1970-01-01 00:00:00', ts)").alias("us"))
    got = {(r.session, r.line, r.began, r.n) for r in run_stream(windows.anchored_budget(timed, logs.WIDTH_US))}
    assert got == {(r.session, r.line, r.began, r.n) for r in logs.anchored_budget(spark, SF).collect()}
    got = {(r.session, r.began) for r in run_stream(windows.expiring_workflows(timed, logs.IDLE_US, logs.WHOLE_US))}
    assert got == {(r.session, r.began) for r in logs.workflow_expiry(spark, SF).collect()}
    got = {(r.session, r.source, r.line) for r in run_stream(windows.latest(stream.select("session", "source", "line", "value"), ["session", "source"], "line"), "complete")}
    assert got == {(r.session, r.source, r.line) for r in logs.newest_result(spark, SF).collect()}
    assert len(run_stream(windows.follow_ups(stream, "session", "ts", "2 hours"), "complete")) == logs.session_followups(spark, SF).count()
