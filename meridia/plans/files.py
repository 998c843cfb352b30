"""What readers and writers make of the tables: each query writes files to the shared folder and reads them again; geodesy and gas."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import gas, geo
from meridia.functions.numeric import rounded, rounded_sql
from meridia.operators.tables import new_folder
from meridia.plans import lens
from meridia.plans.buildings import _TALL
from meridia.plans.registry import query
from meridia.sources import geojson, inventory, observations, packs, sinks, tables


@query("geojson_buildings", f"WITH {lens.BUILDINGS}, {_TALL} SELECT building_id::VARCHAR AS id, height_m, evidence, 4 AS corners, {rounded_sql('lon - half', 7)} AS min_lon, {rounded_sql('lat + half', 7)} AS max_lat FROM tall")
def geojson_buildings(spark, sf_dir):
    """Footprints as GeoJSON lines and back: ids, heights with evidence, rings and bounds."""
    at = new_folder(spark, "geojson")
    b = lens.buildings(spark, sf_dir).select(F.col("building_id").alias("id"), "ring", F.col("height_tag").alias("height"), F.col("levels_tag").alias("building:levels"))
    sinks.feature_lines(b, "ring", ["height", "building:levels"]).write.text(at)
    r = geojson.buildings(spark, at, lines=True)
    return r.select("id", "height_m", "evidence", F.size("ring").alias("corners"), rounded(F.col("min_lon"), 7).alias("min_lon"), rounded(F.col("max_lat"), 7).alias("max_lat"))


@query("external_footprints", f"WITH {lens.BUILDINGS} SELECT building_id::VARCHAR AS id, 5.0::DOUBLE + building_id % 600 AS height_m, 'external' AS source FROM lens_buildings WHERE building_id % 600 <= 495")
def external_footprints(spark, sf_dir):
    """Footprints with heights of another source, as GeoJSON lines and back: only heights up to 500 m."""
    at = new_folder(spark, "external")
    b = lens.buildings(spark, sf_dir).select(F.col("building_id").alias("id"), "ring", (5.0 + F.col("building_id") % 600).alias("height"))
    sinks.feature_lines(b, "ring", ["height"]).write.text(at)
    return geojson.external_heights(spark, at, lines=True).select("id", "height_m", "source")


@query("geojson_towers", f"WITH {lens.CELLS} SELECT cell_id, tech AS radio_type, {rounded_sql('lon', 7)} AS lon, {rounded_sql('lat', 7)} AS lat FROM lens_cells")
def geojson_towers(spark, sf_dir):
    at = new_folder(spark, "towers")
    c = lens.cells(spark, sf_dir).select("cell_id", F.col("tech").alias("radio"), "lon", "lat")
    sinks.point_lines(c, "lon", "lat", ["cell_id", "radio"], F.col("cell_id").cast("string")).write.text(at)
    r = geojson.towers(spark, at, lines=True)
    return r.select("cell_id", "radio_type", rounded(F.col("lon"), 7).alias("lon"), rounded(F.col("lat"), 7).alias("lat"))


@query("inventory_cells", f"WITH {lens.CELLS} SELECT 'c' || cell_id AS id, tech, ghz, mhz, radius_m, azimuth, {rounded_sql('lon', 7)} AS lon, {rounded_sql('lat', 7)} AS lat, NULL::VARCHAR AS problem FROM lens_cells")
def inventory_cells(spark, sf_dir):
    """Inventories as CSV with other names of their columns, and back: a file for each 5,000 cells, as a file has 10,000 at most."""
    at = new_folder(spark, "inventory") + ".csv"
    c = lens.cells(spark, sf_dir)
    c.select(F.concat(F.lit("c"), F.col("cell_id").cast("string")).alias("ID"), F.col("lon").alias("Longitude"), F.col("lat").alias("latitude"), F.upper("tech").alias("radio_type"), F.col("ghz").alias("frequencyGHz"), F.col("mhz").alias("bandwidth_mhz"), "radius_m", F.col("azimuth").alias("orientation_deg")).write.option("maxRecordsPerFile", 5000).csv(at, header=True)
    r = inventory.inventory(spark, at)
    return r.select("id", "tech", "ghz", "mhz", "radius_m", "azimuth", rounded(F.col("lon"), 7).alias("lon"), rounded(F.col("lat"), 7).alias("lat"), "problem")


@query("measurement_rows", f"WITH {lens.SAMPLES}, m AS (SELECT sample_id::VARCHAR AS id, CASE WHEN sample_id % 50 = 0 THEN 99.0 ELSE lat END AS lat, CASE WHEN ghz < 10 THEN '4g' ELSE '5g' END AS technology, rsrp FROM lens_samples) SELECT id, CASE WHEN NOT lat BETWEEN -90 AND 90 THEN 'invalid_coordinates' WHEN NOT rsrp BETWEEN -180 AND -20 THEN 'invalid_rsrp' END AS broken, CASE WHEN lat BETWEEN -90 AND 90 AND rsrp BETWEEN -180 AND -20 THEN technology END AS technology FROM m")
def measurement_rows(spark, sf_dir):
    """Measurements as CSV and back: valid rows, and the others with the first rule they break."""
    at = new_folder(spark, "measurements")
    s = lens.samples(spark, sf_dir)
    s.select(F.col("sample_id").alias("id"), F.col("lon").alias("longitude"), F.when(F.col("sample_id") % 50 == 0, 99.0).otherwise(F.col("lat")).alias("lat"), F.when(F.col("ghz") < 10, "4G").otherwise("5G").alias("technology"), F.col("rsrp")).write.csv(at, header=True)
    good, bad = tables.measurements(spark, at)
    return good.select("id", F.lit(None).cast("string").alias("broken"), "technology").unionByName(bad.select("id", "broken", F.lit(None).cast("string").alias("technology")))


@query("pack_layers", f"WITH {lens.CELLS}, {lens.BUILDINGS} SELECT 'cells' AS layer, count(*)::BIGINT AS n, sum(cell_id)::BIGINT AS ids FROM lens_cells UNION ALL SELECT 'buildings', count(*)::BIGINT, sum(building_id)::BIGINT FROM lens_buildings")
def pack_layers(spark, sf_dir):
    """A dataset pack written with checksums, checked and loaded."""
    at = new_folder(spark, "pack")
    packs.build_pack(spark, at, "lens", {"cells": lens.cells(spark, sf_dir), "buildings": lens.buildings(spark, sf_dir)})
    got = packs.load_pack(spark, at, views=False)
    count = lambda layer, key: got[layer].agg(F.count("*").alias("n"), F.sum(key).alias("ids")).select(F.lit(layer).alias("layer"), "n", "ids")
    return count("cells", "cell_id").unionByName(count("buildings", "building_id"))


_SPHERE = "asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b))"
_TURN = "(((azimuth_b - azimuth_a + 540.0) % 360.0 + 360.0) % 360.0 - 180.0)"
_T = "greatest(0.0, least(1.0, coalesce(-(px * dx + py * dy) / nullif(dx * dx + dy * dy, 0), 0.0)))"


@query("geodesy", f"""WITH {lens.SAMPLES}, s AS (SELECT sample_id, lon, lat, distance_m / 6371000.0 AS d, radians((sample_id * 53 % 360)::DOUBLE) AS b, radians(lat) AS p, (sample_id * 53 % 360)::DOUBLE AS azimuth_a, (sample_id * 91 % 360)::DOUBLE AS azimuth_b, (32.85 - lon) * 111320.0 * cos(radians(lat)) AS px, (39.92 - lat) * 111320.0 AS py, 0.1 * 111320.0 * cos(radians(lat)) AS dx, 0.05 * 111320.0 AS dy FROM lens_samples)
 SELECT sample_id, {rounded_sql(f'((lon + degrees(atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin({_SPHERE}))) + 540.0) % 360.0) - 180.0', 7)} AS lon, {rounded_sql(f'degrees({_SPHERE})', 7)} AS lat, {rounded_sql(_TURN, 4)} AS turn, {rounded_sql(f'sqrt(pow(px + {_T} * dx, 2) + pow(py + {_T} * dy, 2))', 3)} AS to_road_m FROM s""")
def geodesy(spark, sf_dir):
    """Where a bearing and a distance lead on the sphere, the signed turn between two azimuths, metres to a segment."""
    k = F.col("sample_id")
    a, b = (k * 53 % 360).cast("double"), (k * 91 % 360).cast("double")
    lon, lat = geo.destination(F.col("lon"), F.col("lat"), a, F.col("distance_m"))
    road = geo.to_segment_m(F.col("lon"), F.col("lat"), F.lit(32.85), F.lit(39.92), F.lit(32.95), F.lit(39.97))
    return lens.samples(spark, sf_dir).select("sample_id", rounded(lon, 7).alias("lon"), rounded(lat, 7).alias("lat"), rounded(geo.turn_deg(b, a), 4).alias("turn"), rounded(road, 3).alias("to_road_m"))


@query("boundary_points", f"WITH {lens.BUILDINGS} SELECT building_id, true AS corner, true AS edge, true AS inside, false AS outside FROM lens_buildings")
def boundary_points(spark, sf_dir):
    """A corner, the middle of an edge, the centre and a far point of each footprint, by the rule that takes the boundary in."""
    b = lens.buildings(spark, sf_dir)
    at = lambda lon, lat: geo.in_or_on_polygon(lon, lat, F.col("ring"))
    v = F.element_at("ring", 1)
    return b.select("building_id", at(v["lon"], v["lat"]).alias("corner"), at(F.col("lon"), v["lat"]).alias("edge"), at(F.col("lon"), F.col("lat")).alias("inside"), at(F.col("lon") + 3 * F.col("half"), F.col("lat")).alias("outside"))


_ROWS = lambda lines: ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" for x in r) + ")" for r in lines)


@query("gas_absorption", f"""WITH {lens.CELLS}, p AS (SELECT cell_id, 20.0 + cell_id % 180 AS ghz, 1013.25 - cell_id % 200 AS dry, 300 / (270.0 + cell_id % 40) AS th, (cell_id % 20) * (270.0 + cell_id % 40) / 216.7 AS e FROM lens_cells),
 o(f0, a1, a2, a3, a4, a5, a6) AS (VALUES {_ROWS(gas.OXYGEN_LINES)}), w(f0, b1, b2, b3, b4, b5, b6) AS (VALUES {_ROWS(gas.WATER_LINES)}),
 ox AS (SELECT *, sqrt(pow(a3 * 1e-4 * (dry * pow(th, 0.8 - a4) + 1.1 * e * th), 2) + 2.25e-6) AS wd, (a5 + a6 * th) * 1e-4 * (dry + e) * pow(th, 0.8) AS sh, f0 - ghz AS n, f0 + ghz AS f FROM p, o),
 os AS (SELECT cell_id, sum(0.1820 * ghz * a1 * 1e-7 * dry * pow(th, 3) * exp(a2 * (1 - th)) * ghz / f0 * ((wd - sh * n) / (n * n + wd * wd) + (wd - sh * f) / (f * f + wd * wd))) AS oxygen FROM ox GROUP BY cell_id),
 wx AS (SELECT *, b3 * 1e-4 * (dry * pow(th, b4) + b5 * e * pow(th, b6)) AS q, f0 - ghz AS n, f0 + ghz AS f FROM p, w), wy AS (SELECT *, 0.535 * q + sqrt(0.217 * q * q + 2.1316e-12 * f0 * f0 / th) AS wd FROM wx),
 ws AS (SELECT cell_id, sum(0.1820 * ghz * b1 * 0.1 * e * pow(th, 3.5) * exp(b2 * (1 - th)) * ghz / f0 * (wd / (n * n + wd * wd) + wd / (f * f + wd * wd))) AS water FROM wy GROUP BY cell_id)
 SELECT cell_id, {rounded_sql('oxygen', 6)} AS oxygen, {rounded_sql('water', 6)} AS water, {rounded_sql('0.1820 * ghz * ghz * dry * th * th * (6.14e-5 / (5.6e-4 * (dry + e) * pow(th, 0.8) * (1 + pow(ghz / (5.6e-4 * (dry + e) * pow(th, 0.8)), 2))) + 1.4e-12 * dry * pow(th, 1.5) / (1 + 1.9e-5 * pow(ghz, 1.5)))', 6)} AS dry FROM p JOIN os USING (cell_id) JOIN ws USING (cell_id)""")
def gas_absorption(spark, sf_dir):
    """Oxygen, water and dry continuum in dB per km, line by line, at each cell's weather."""
    k = F.col("cell_id")
    points = lens.cells(spark, sf_dir).select("cell_id", (20.0 + k % 180).alias("ghz"), (1013.25 - k % 200).alias("dry_hpa"), (270.0 + k % 40).alias("kelvin"), (k % 20).cast("double").alias("grams_m3"))
    a = gas.absorption(points, spark.createDataFrame(list(gas.OXYGEN_LINES), list(gas.OXYGEN)), spark.createDataFrame(list(gas.WATER_LINES), list(gas.WATER)), ["cell_id"])
    return a.select("cell_id", *(rounded(F.col(c), 6).alias(c) for c in ("oxygen", "water", "dry")))


#: A campaign a line: groups of 512 samples; every fifth line is followed by one that is no JSON.
_CAMPAIGN = 512


@query("campaign_observations", f"""WITH {lens.SAMPLES}, k AS (SELECT *, sample_id AS k, sample_id // {_CAMPAIGN} AS g FROM lens_samples),
 e AS (SELECT *, CASE WHEN k % 3 = 0 THEN ghz WHEN g % 2 = 0 THEN 28.0::DOUBLE END AS f, ['path_loss', 'path_gain', 'received_power', 'another'][k % 4 + 1] AS quantity, k % 7 = 0 AS unflagged FROM k),
 r AS (SELECT *, CASE quantity WHEN 'path_loss' THEN CASE WHEN unflagged THEN 'flags_missing' END WHEN 'path_gain' THEN CASE WHEN unflagged THEN 'flags_missing' END WHEN 'received_power' THEN CASE WHEN unflagged AND g % 4 = 3 THEN 'not_calibrated' END ELSE 'quantity' END AS reason FROM e)
 SELECT 'm' || k AS measurement_id, f AS ghz, CASE WHEN k % 5 = 0 THEN 'los' WHEN g % 3 <> 0 THEN 'nlos' END AS los, CASE WHEN k % 5 = 0 THEN 'seen' WHEN g % 3 <> 0 THEN 'map' END AS los_source, CASE WHEN k % 2 = 0 THEN 'suburban' ELSE 'urban_high_rise' END AS morphology, CASE WHEN k % 2 = 0 THEN 'site' ELSE 'map' END AS morphology_source,
  CASE WHEN k % 6 = 0 THEN 300.0::DOUBLE WHEN g % 2 = 0 THEN 280.0::DOUBLE + g % 20 END AS kelvin, {rounded_sql("CASE WHEN reason IS NULL THEN CASE quantity WHEN 'received_power' THEN 30.0 + 10.0 + 2.0 - 1.0 - 0.5 - rsrp ELSE 100.0 + residual END END", 4)} AS measured_db, reason FROM r
 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid_json' FROM (SELECT DISTINCT g FROM k WHERE g % 5 = 0)""")
def campaign_observations(spark, sf_dir):
    """Measurements as campaigns of JSON, one a line, and back through the data source: each value from the record, its site or its campaign."""
    k = F.col("sample_id")
    g = F.floor(k / _CAMPAIGN)
    flag = F.when(k % 7 != 0, F.lit(True))
    record = F.struct(
        F.concat(F.lit("m"), k.cast("string")).alias("measurement_id"), F.when(k % 2 == 0, "s0").alias("site_id"), F.when(k % 3 == 0, F.col("ghz")).alias("frequency_ghz"), F.element_at(F.array(*map(F.lit, ("path_loss", "path_gain", "received_power", "another"))), (k % 4 + 1).cast("int")).alias("measurement_quantity"),
        (100.0 + F.col("residual")).alias("measured_path_loss_db"), (-100.0 - F.col("residual")).alias("measured_path_gain_db"), F.col("rsrp").alias("measured_received_power_dbm"), flag.alias("antenna_gain_embedded"), flag.alias("cable_loss_embedded"), flag.alias("calibration_applied"),
        F.when(k % 5 == 0, F.struct(F.lit("Line_of_Sight").alias("los_nlos"), F.lit("seen").alias("los_nlos_source"))).alias("labels"), F.when(k % 6 == 0, F.struct(F.lit(300.0).alias("temperature_k"))).alias("weather"),
    )
    one = lens.samples(spark, sf_dir).groupBy(g.alias("g")).agg(F.collect_list(record).alias("measurements"))  # at most _CAMPAIGN records
    x = F.col("g")
    campaign = F.struct(
        F.concat(F.lit("c"), x.cast("string")).alias("campaign_id"), F.struct(F.lit(28.0).alias("min_ghz"), F.when(x % 2 == 0, 28.0).otherwise(30.0).alias("max_ghz")).alias("frequency_range_ghz"),
        F.struct(F.when(x % 3 != 0, "NLOS").alias("los_state"), F.lit("map").alias("los_source"), F.lit("highrise").alias("morphology"), F.lit("map").alias("morphology_source")).alias("environment"),
        F.struct(F.lit("isotropic").alias("directionality"), F.lit(observations.BASES[0]).alias("comparison_basis"), F.lit(10.0).alias("tx_gain_dbi"), F.lit(2.0).alias("rx_gain_dbi")).alias("antenna_setup"),
        F.struct(F.lit(30.0).alias("conducted_tx_power_dbm"), F.lit(1.0).alias("tx_cable_loss_db"), F.lit(0.5).alias("rx_cable_loss_db"), (x % 4 != 3).alias("receiver_calibration_applied")).alias("calibration"),
        F.when(x % 2 == 0, F.struct((280.0 + x % 20).alias("temperature_k"))).alias("weather"), F.array(F.struct(F.lit("s0").alias("site_id"), F.lit("suburban").alias("morphology"), F.lit("site").alias("morphology_source"))).alias("sites"), "measurements",
    )
    line = F.explode(F.when(x % 5 == 0, F.array(F.to_json(campaign), F.lit("{no json"))).otherwise(F.array(F.to_json(campaign))))
    at = new_folder(spark, "campaigns")
    one.select(line.alias("value")).write.text(at)
    observations.register(spark)
    m = observations.normalised(spark.read.format("observations").option("lines", "true").load(at))
    return m.select("measurement_id", "ghz", "los", "los_source", "morphology", "morphology_source", "kelvin", rounded(F.col("measured_db"), 4).alias("measured_db"), "reason")
