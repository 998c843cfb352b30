"""Serving cells, interference and radio quality over sample points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geo, rf
from meridia.functions.numeric import rounded, rounded_sql
from meridia.operators import stats
from meridia.operators.joins import box_join, disc_kernel, disc_stream, in_discs, within_beam
from meridia.operators.tables import shared_table
from meridia.plans import lens
from meridia.plans.registry import query

POWER_DBM, GAIN_DBI, BEAM_DEG, TX_M, RX_M, FIGURE_DB = 30.0, 25.0, 120.0, 25.0, 1.5, 7.0


def links(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Received reference power of each cell at each point in its radius, where above the sensitivity, with the ``bearing`` to it:
    what does not depend on where the antenna points."""
    near = box_join(points, "lon", "lat", cells.withColumnsRenamed({"lon": "cell_lon", "lat": "cell_lat"}), geo.bounds_around(F.col("cell_lon"), F.col("cell_lat"), F.col("radius_m") * 1.01))
    d = geo.distance_m(F.col("cell_lon"), F.col("cell_lat"), F.col("lon"), F.col("lat"))
    near = near.withColumn("d", d).where("d <= radius_m")
    near = near.withColumn("bearing", geo.bearing_deg(F.col("cell_lon"), F.col("cell_lat"), F.col("lon"), F.col("lat")))
    carrier = POWER_DBM + GAIN_DBI - rf.free_space_loss(rf.slant_m(F.col("d"), F.lit(TX_M), F.lit(RX_M)), F.col("ghz"))
    rb = rf.resource_blocks(F.col("tech"), F.col("mhz"))
    return near.withColumn("carrier", carrier).where(F.col("carrier") > rf.SENSITIVITY_DBM).withColumn("rb", rb).withColumn("rsrp", F.col("carrier") - 10 * F.log10(12.0 * rb))


def signals(points: DataFrame, cells: DataFrame) -> DataFrame:
    """The links of each point that lie in the cell's beam."""
    return links(points, cells).where(geo.in_beam(F.col("bearing"), F.col("azimuth"), F.lit(BEAM_DEG))).drop("bearing")


_SERVING = "sample_id long, cell_id long, n_signals long, n_same long, rsrp double, all_scaled double"


def _serving(points: dict, cells: dict) -> dict:
    """Of each point with a signal: the strongest cell (then the lowest id), and the sum and number of signals of its carrier."""
    n = len(points["lon"])
    rsrp, serving, signals_of = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    names, carrier = np.unique([f"{t}|{c}|{g}|{m}" for t, c, g, m in zip(*(cells[k] for k in ("tech", "channel", "ghz", "mhz")))], return_inverse=True)
    scaled, same = np.zeros((len(names), n)), np.zeros((len(names), n), np.int64)
    for j, i, d, x, y in in_discs(points, cells):
        power = POWER_DBM + GAIN_DBI - (20 * np.log10(np.maximum(np.sqrt(d * d + (TX_M - RX_M) ** 2), 1.0)) + cells["ghz_db"][j] + 32.45)
        on = (power > rf.SENSITIVITY_DBM) & within_beam(x, y, cells["azimuth"][j], BEAM_DEG)
        i, r = i[on], power[on] - cells["rb_db"][j]
        signals_of[i] += 1
        scaled[carrier[j], i] += 10.0 ** (r / 10) * cells["load"][j]
        same[carrier[j], i] += 1
        better = r > rsrp[i]  # cells come by id, so of equal ones the lowest stays
        rsrp[i[better]], serving[i[better]] = r[better], j
    i = np.flatnonzero(signals_of)
    k = carrier[serving[i]]
    return {"sample_id": points["sample_id"][i], "cell_id": cells["cell_id"][serving[i]], "n_signals": signals_of[i], "n_same": same[k, i], "rsrp": rsrp[i], "all_scaled": scaled[k, i]}


#: Samples that are ranked together.
RANKED = 256


def _signals_of(points: dict, cells: dict) -> Iterator[dict]:
    """A few points at a time, the ranks of their signals by power, then by cell. Points of one id are ranked together, as in the SQL."""
    near = np.lexsort((points["sample_id"], points["lat"], points["lon"]))  # neighbours together: fewer cells reach a part of them
    others = np.append(np.flatnonzero(np.diff(points["sample_id"][near])) + 1, len(near))
    cuts = np.unique(others[np.searchsorted(others, np.arange(RANKED, len(near) + RANKED, RANKED).clip(max=len(near)))])
    for some in np.split(near, cuts[:-1]):
        part = {c: v[some] for c, v in points.items()}
        who = np.unique(part["sample_id"], return_inverse=True)[1]
        reach = cells["radius_m"] * 1.01 / 111_320.0
        held = (cells["lat"] + reach >= part["lat"].min()) & (cells["lat"] - reach <= part["lat"].max())
        held &= (cells["lon"] + reach / cells["scale"] >= part["lon"].min()) & (cells["lon"] - reach / cells["scale"] <= part["lon"].max())
        some, of, rsrp, ids = {c: v[held] for c, v in cells.items()}, [], [], []
        for j, i, d, x, y in in_discs(part, some):
            power = POWER_DBM + GAIN_DBI - (20 * np.log10(np.maximum(np.sqrt(d * d + (TX_M - RX_M) ** 2), 1.0)) + some["ghz_db"][j] + 32.45)
            on = (power > rf.SENSITIVITY_DBM) & within_beam(x, y, some["azimuth"][j], BEAM_DEG)
            of.append(i[on])
            rsrp.append(power[on] - some["rb_db"][j])
            ids.append(np.full(on.sum(), some["cell_id"][j]))
        if of:
            of, rsrp, ids = (np.concatenate(v) for v in (of, rsrp, ids))
            order = np.lexsort((ids, -rsrp, who[of]))
            of = of[order]
            first = np.searchsorted(who[of], np.arange(len(part["lon"])))
            yield {"sample_id": part["sample_id"][of], "cell_id": ids[order], "rank": np.arange(len(of)) - first[who[of]] + 1, "rsrp": rsrp[order]}


def _discs(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"ghz_db": 20 * F.log10("ghz"), "rb_db": 10 * F.log10(12.0 * rf.resource_blocks(F.col("tech"), F.col("mhz")))})


def ranked(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(sample_id, cell_id, rank, rsrp) of ``signals``."""
    discs = _discs(cells).select("cell_id", "lon", "lat", "radius_m", "azimuth", "ghz_db", "rb_db")
    return disc_stream(points.select("sample_id", "lon", "lat"), discs, _signals_of, "sample_id long, cell_id long, rank int, rsrp double")


def quality(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Of each point with a signal: serving cell (strongest, then lowest id), interference of its carrier, SINR, RSRQ, class.

    Signals are summed where they are found, a grid cell at a time: their number is that of points times cells in reach."""
    c = cells.withColumn("rb", rf.resource_blocks(F.col("tech"), F.col("mhz")))
    discs = _discs(c).select("cell_id", "lon", "lat", "radius_m", "azimuth", "tech", "channel", "ghz", "mhz", "load", "ghz_db", "rb_db")
    best = disc_kernel(points.select("sample_id", "lon", "lat"), discs, _serving, _SERVING)
    best = best.join(c.select("cell_id", "tech", "channel", "ghz", "mhz", "load", "rb"), "cell_id")
    best = best.withColumn("mw", rf.milliwatts(F.col("rsrp"))).withColumn("scaled", F.col("mw") * F.col("load"))
    noise = rf.milliwatts(rf.thermal_noise(rf.spacing_khz(F.col("tech")) * 1000, F.lit(FIGURE_DB)))
    best = best.withColumn("i_mw", F.when(F.col("n_same") == 1, 0.0).otherwise(F.greatest(F.col("all_scaled") - F.col("scaled"), F.lit(0.0)))).withColumn("n_mw", noise)
    best = best.withColumn("sinr", 10 * F.log10(F.col("mw") / (F.col("i_mw") + F.col("n_mw"))))
    best = best.withColumn("rsrq", 10 * F.log10(F.col("rb") * F.col("mw") / (12 * F.col("rb") * (F.col("mw") + F.col("i_mw") + F.col("n_mw")))))
    cols = [F.col(c) for c in ("rsrp", "sinr", "rsrq")]
    return best.withColumn("failures", rf.serviceability_failures(*cols)).withColumn("class", rf.quality_class(*cols)).withColumn("serviceable", F.size("failures") == 0)


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(lens.samples(spark, sf_dir), lens.cells(spark, sf_dir))


_PLANAR = f"sqrt(pow((s.lon - c.lon) * {geo.DEGREE_M} * cos(radians(c.lat)), 2) + pow((s.lat - c.lat) * {geo.DEGREE_M}, 2))"
_BEARING = "((degrees(atan2((s.lon - c.lon) * cos(radians(c.lat)), s.lat - c.lat)) + 360.0) % 360.0)"
_FSPL = f"(20 * log10(greatest(sqrt(d * d + {(TX_M - RX_M) ** 2}), 1.0)) + 20 * log10(ghz) + 32.45)"
_RB = "CASE tech WHEN '4g' THEN 100 ELSE 66 END"
SIGNALS = f"""WITH {lens.CELLS}, {lens.SAMPLES},
pairs AS (SELECT s.sample_id, c.*, {_PLANAR} AS d, {_BEARING} AS bearing FROM lens_samples s JOIN lens_cells c ON {_PLANAR} <= c.radius_m),
sig AS (SELECT *, {POWER_DBM + GAIN_DBI} - {_FSPL} AS carrier, {_RB} AS rb FROM pairs WHERE abs(((bearing - azimuth + 540.0) % 360.0) - 180.0) <= {BEAM_DEG / 2}),
eligible AS (SELECT *, carrier - 10 * log10(12.0 * rb) AS rsrp FROM sig WHERE carrier > {rf.SENSITIVITY_DBM}),
power AS (SELECT *, pow(10.0, rsrp / 10) AS mw, pow(10.0, rsrp / 10) * load AS scaled FROM eligible),
ranked AS (SELECT *, sum(scaled) OVER (PARTITION BY sample_id, tech, channel, ghz, mhz) AS all_scaled, count(*) OVER (PARTITION BY sample_id, tech, channel, ghz, mhz) AS n_same,
  count(*) OVER (PARTITION BY sample_id) AS n_signals, row_number() OVER (PARTITION BY sample_id ORDER BY rsrp DESC, cell_id) AS r FROM power),
serving AS (SELECT *, CASE WHEN n_same = 1 THEN 0.0 ELSE greatest(all_scaled - scaled, 0.0) END AS i_mw, pow(10.0, ({rf.THERMAL_DBM_HZ} + 10 * log10(CASE tech WHEN '4g' THEN 15000.0 ELSE 120000.0 END) + {FIGURE_DB}) / 10) AS n_mw FROM ranked WHERE r = 1),
q AS (SELECT *, 10 * log10(mw / (i_mw + n_mw)) AS sinr, 10 * log10(rb * mw / (12 * rb * (mw + i_mw + n_mw))) AS rsrq FROM serving),
quality AS (SELECT *, CASE WHEN rsrp < -100 OR sinr < 0 OR rsrq < -20 THEN 'poor' WHEN rsrp < -90 OR sinr < 13 OR rsrq < -15 THEN 'fair' WHEN rsrp < -80 OR sinr < 20 OR rsrq < -10 THEN 'good' ELSE 'excellent' END AS class,
  rsrp >= {rf.MIN_RSRP} AND sinr >= {rf.MIN_SINR} AND rsrq >= {rf.MIN_RSRQ} AS serviceable FROM q)
"""


def _avg(c: str) -> str:
    return f"{rounded_sql(f'avg({c})', 3)} AS avg_{c}"


@query("serving_cell_summary", SIGNALS + f"""SELECT cell_id, count(*)::BIGINT AS n_samples, {_avg('rsrp')}, {_avg('sinr')}, {_avg('rsrq')}, {rounded_sql("100.0 * count(*) FILTER (serviceable) / count(*)", 1)} AS serviceable_pct FROM quality GROUP BY cell_id""")
def serving_cell_summary(spark, sf_dir):
    q = _quality(spark, sf_dir)
    return q.groupBy("cell_id").agg(F.count("*").alias("n_samples"), *(rounded(F.avg(c), 3).alias(f"avg_{c}") for c in ("rsrp", "sinr", "rsrq")), rounded(100.0 * F.count_if("serviceable") / F.count("*"), 1).alias("serviceable_pct"))


@query("serving_cell_rank", SIGNALS + f"SELECT sample_id, cell_id, r::INTEGER AS rank, {rounded_sql('rsrp', 4)} AS rsrp FROM ranked")
def serving_cell_rank(spark, sf_dir):
    """The signals of each sample, the strongest first (then the lowest id). They are ranked where they are found and leave the task as they
    are made: a row each is the result, but none is shuffled or sorted on disk."""
    r = ranked(lens.samples(spark, sf_dir), lens.cells(spark, sf_dir))
    return r.select("sample_id", "cell_id", "rank", rounded(F.col("rsrp"), 4).alias("rsrp"))


@query("interference_ledger", SIGNALS + f"SELECT sample_id, cell_id, n_signals::BIGINT AS n_signals, (n_same - 1)::BIGINT AS n_interferers, {rounded_sql('rsrp', 3)} AS rsrp, {rounded_sql('sinr', 3)} AS sinr, {rounded_sql('rsrq', 3)} AS rsrq, class AS quality, serviceable FROM quality")
def interference_ledger(spark, sf_dir):
    return _quality(spark, sf_dir).select("sample_id", "cell_id", "n_signals", (F.col("n_same") - 1).alias("n_interferers"), *(rounded(F.col(c), 3).alias(c) for c in ("rsrp", "sinr", "rsrq")), F.col("class").alias("quality"), "serviceable")


@query("radio_quality_stats", SIGNALS + f"""SELECT (SELECT count(*) FROM lens_samples)::BIGINT AS n_samples, count(*)::BIGINT AS n_signal, count(*) FILTER (serviceable)::BIGINT AS n_serviceable,
 {rounded_sql("100.0 * count(*) FILTER (serviceable) / (SELECT count(*) FROM lens_samples)", 1)} AS serviceable_pct, {_avg('sinr')}, {rounded_sql('quantile_disc(sinr, 0.1)', 3)} AS p10_sinr, {rounded_sql('quantile_disc(sinr, 0.5)', 3)} AS p50_sinr FROM quality""")
def radio_quality_stats(spark, sf_dir):
    points = lens.samples(spark, sf_dir)
    q = shared_table(quality(points, lens.cells(spark, sf_dir)).select("sample_id", "sinr", "serviceable"), "quality")  # read twice
    every = points.select("sample_id").join(q, "sample_id", "left")
    served = F.count_if(F.coalesce("serviceable", F.lit(False)))
    tails = stats.quantiles(q, [], "sinr", ranks={"p10_sinr": 0.1, "p50_sinr": 0.5})
    whole = every.agg(F.count("*").alias("n_samples"), F.count("sinr").alias("n_signal"), served.alias("n_serviceable"), rounded(100.0 * served / F.count("*"), 1).alias("serviceable_pct"), rounded(F.avg("sinr"), 3).alias("avg_sinr"))
    return whole.join(F.broadcast(tails)).select(*whole.columns, *(rounded(F.col(c), 3).alias(c) for c in ("p10_sinr", "p50_sinr")))  # one row each


@query("outage_by_reason", SIGNALS + f"""SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter([CASE WHEN rsrp < {rf.MIN_RSRP} THEN 'rsrp' END, CASE WHEN sinr < {rf.MIN_SINR} THEN 'sinr' END, CASE WHEN rsrq < {rf.MIN_RSRQ} THEN 'rsrq' END], lambda x: x IS NOT NULL)) AS reason FROM quality
 UNION ALL SELECT 'no_signal' FROM lens_samples s WHERE NOT EXISTS (SELECT 1 FROM quality q WHERE q.sample_id = s.sample_id)) GROUP BY reason""")
def outage_by_reason(spark, sf_dir):
    points = lens.samples(spark, sf_dir)
    q = quality(points, lens.cells(spark, sf_dir)).select("sample_id", "failures")
    reasons = points.select("sample_id").join(q, "sample_id", "left").select(F.explode(F.coalesce("failures", F.array(F.lit("no_signal")))).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


@query("quality_class_counts", SIGNALS + "SELECT class AS quality, tech, count(*)::BIGINT AS n FROM quality GROUP BY ALL")
def quality_class_counts(spark, sf_dir):
    return _quality(spark, sf_dir).groupBy(F.col("class").alias("quality"), "tech").agg(F.count("*").alias("n"))


_PATTERNS = ("ideal-sector", "cosine-sector", "omni", "3gpp-single-element")
_CUTS = ("flat", "panel-10deg", "panel-20deg")
_LINK = f"""WITH {lens.SAMPLES}, l AS (SELECT sample_id, distance_m AS d, ghz, walls, los, (sample_id * 53 % 360)::DOUBLE - 180.0 AS off_az, {lens._pick_sql(_PATTERNS, 'sample_id')} AS h, {lens._pick_sql(_CUTS, '(sample_id // 4)')} AS v,
 degrees(atan2({TX_M - RX_M}, greatest(distance_m, 0.1))) - 4.0 AS off_tilt, sqrt(distance_m * distance_m + {(TX_M - RX_M) ** 2}) AS slant FROM lens_samples),
 cut AS (SELECT *, least(30.0, 12 * pow(abs(off_az) / 60.0, 2)) AS sector, least(30.0, 12 * pow(abs(off_az) / 65.0, 2)) AS el_h, least(30.0, 12 * pow(abs(off_tilt) / 65.0, 2)) AS el_v,
 CASE v WHEN 'panel-10deg' THEN least(30.0, 12 * pow(abs(off_tilt) / 10.0, 2)) WHEN 'panel-20deg' THEN least(30.0, 12 * pow(abs(off_tilt) / 20.0, 2)) ELSE 0.0 END AS tilt FROM l),
 p AS (SELECT *, CASE h WHEN '3gpp-single-element' THEN least(30.0, el_h + el_v) WHEN 'cosine-sector' THEN sector + tilt ELSE tilt END AS pattern FROM cut)
"""


def _links(spark, sf_dir):
    d = lens.samples(spark, sf_dir).select("sample_id", F.col("distance_m").alias("d"), "ghz", "walls", "los", ((F.col("sample_id") * 53 % 360).cast("double") - 180.0).alias("off_az"), lens._pick(_PATTERNS, F.col("sample_id")).alias("h"), lens._pick(_CUTS, F.floor(F.col("sample_id") / 4)).alias("v"))
    d = d.withColumn("off_tilt", rf.tilt_offset(F.col("d"), F.lit(TX_M), F.lit(RX_M), F.lit(4.0))).withColumn("slant", rf.slant_m(F.col("d"), F.lit(TX_M), F.lit(RX_M)))
    return d.withColumn("pattern", rf.pattern_loss(F.col("h"), F.col("v"), F.col("off_az"), F.col("off_tilt"), F.lit(BEAM_DEG)))


@query("link_budget", _LINK + f"""SELECT sample_id, {rounded_sql('pattern', 4)} AS pattern_db, {rounded_sql('20 * log10(greatest(slant, 1.0)) + 20 * log10(ghz) + 32.45', 4)} AS free_space_db, walls * CASE WHEN ghz < 10 THEN 8.0::DOUBLE ELSE 30.0::DOUBLE END AS wall_db,
 {rounded_sql(f"{POWER_DBM + GAIN_DBI} - pattern - (20 * log10(greatest(slant, 1.0)) + 20 * log10(ghz) + 32.45) - walls * CASE WHEN ghz < 10 THEN 8.0 ELSE 30.0 END", 4)} AS received_dbm FROM p""")
def link_budget(spark, sf_dir):
    loss, wall = rf.free_space_loss(F.col("slant"), F.col("ghz")), F.col("walls") * rf.wall_loss(F.col("ghz"))
    return _links(spark, sf_dir).select("sample_id", rounded(F.col("pattern"), 4).alias("pattern_db"), rounded(loss, 4).alias("free_space_db"), wall.alias("wall_db"), rounded(POWER_DBM + GAIN_DBI - F.col("pattern") - loss - wall, 4).alias("received_dbm"))


@query("urban_path_loss", _LINK + f""", b AS (SELECT *, 4 * {TX_M - 1} * {RX_M - 1} * ghz * 1e9 / 3e8 AS bp, log10(greatest(slant, 1.0)) AS ld, 20 * log10(ghz) AS lf FROM p),
 m AS (SELECT *, CASE WHEN d > bp THEN 28 + 40 * ld + lf - 9 * log10(bp * bp + {(TX_M - RX_M) ** 2}) ELSE 28 + 22 * ld + lf END AS seen, CASE WHEN NOT d BETWEEN 10 AND 5000 THEN 'distance_out_of_range' WHEN los = 'unknown' THEN 'required_los_or_nlos_missing' END AS refusal FROM b)
 SELECT sample_id, refusal, CASE WHEN refusal IS NULL THEN 'urban' ELSE 'free_space_walls' END AS model,
 {rounded_sql(f"CASE WHEN refusal IS NOT NULL THEN 20 * ld + lf + 32.45 + walls * CASE WHEN ghz < 10 THEN 8.0 ELSE 30.0 END WHEN los = 'los' THEN seen ELSE greatest(seen, 13.54 + 39.08 * ld + lf - 0.6 * {RX_M - 1.5}) END", 4)} AS loss_db FROM m""")
def urban_path_loss(spark, sf_dir):
    l = _links(spark, sf_dir)
    refusal = rf.urban_refusal(F.col("d"), F.col("ghz"), F.lit(TX_M), F.lit(RX_M), F.lit(True), F.lit(True), F.col("los"))
    urban = rf.urban_loss(F.col("d"), F.col("slant"), F.col("ghz"), F.lit(TX_M), F.lit(RX_M), F.col("los") == "los")
    plain = rf.free_space_loss(F.col("slant"), F.col("ghz")) + F.col("walls") * rf.wall_loss(F.col("ghz"))
    l = l.withColumn("refusal", refusal)
    return l.select("sample_id", "refusal", F.when(F.col("refusal").isNull(), "urban").otherwise("free_space_walls").alias("model"), rounded(F.when(F.col("refusal").isNull(), urban).otherwise(plain), 4).alias("loss_db"))


@query("knife_edge", f"""WITH {lens.SAMPLES}, v AS (SELECT sample_id, residual * sqrt(2 * (distance_m + 1 + 200.0) / (0.299792458 / ghz * (distance_m + 1) * 200.0)) AS v FROM lens_samples)
 SELECT sample_id, {rounded_sql('v', 5)} AS v, {rounded_sql('CASE WHEN v <= -0.78 THEN 0.0 ELSE greatest(0.0, 6.9 + 20 * log10(sqrt(pow(v - 0.1, 2) + 1) + v - 0.1)) END', 5)} AS loss_db FROM v""")
def knife_edge(spark, sf_dir):
    v = rf.knife_edge_v(F.col("residual"), F.col("distance_m") + 1, F.lit(200.0), F.col("ghz"))
    return lens.samples(spark, sf_dir).select("sample_id", v.alias("v")).select("sample_id", rounded(F.col("v"), 5).alias("v"), rounded(rf.knife_edge_loss(F.col("v")), 5).alias("loss_db"))


@query("entry_and_noise", f"""WITH {lens.CELLS} SELECT cell_id, {rounded_sql("CASE WHEN tech = '4g' THEN 20.0 ELSE 5 - 10 * log10(0.3 * pow(10.0, -(2 + 0.2 * ghz) / 10) + 0.7 * pow(10.0, -(5 + 4 * ghz) / 10)) END", 4)} AS low_entry_db,
 {rounded_sql("CASE WHEN tech = '4g' THEN 20.0 ELSE 5 - 10 * log10(0.7 * pow(10.0, -(25.4 + 0.11 * ghz) / 10) + 0.3 * pow(10.0, -(5 + 4 * ghz) / 10)) END", 4)} AS high_entry_db,
 {rounded_sql("-174.0 + 10 * log10(CASE tech WHEN '4g' THEN 15000.0 ELSE 120000.0 END) + 7.0", 4)} AS noise_re_dbm, {rounded_sql("pow(10.0, (55.0 + 115.0 - 8.0 - 20 * log10(ghz) - 32.45) / 20)", 2)} AS reach_m FROM lens_cells""")
def entry_and_noise(spark, sf_dir):
    g = F.col("ghz")
    return lens.cells(spark, sf_dir).select("cell_id", rounded(rf.entry_loss(g, F.lit(False)), 4).alias("low_entry_db"), rounded(rf.entry_loss(g, F.lit(True)), 4).alias("high_entry_db"), rounded(rf.thermal_noise(rf.spacing_khz(F.col("tech")) * 1000, F.lit(FIGURE_DB)), 4).alias("noise_re_dbm"), rounded(rf.reach_m(F.lit(55.0), g, F.lit(8.0)), 2).alias("reach_m"))
