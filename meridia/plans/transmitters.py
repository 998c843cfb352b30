"""Observations and the transmitters they belong to."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import matching
from meridia.plans import lens
from meridia.plans.registry import query

_D = "sqrt(pow((o.lon - t.lon) * 111320.0 * cos(radians(t.lat)), 2) + pow((o.lat - t.lat) * 111320.0, 2))"


@query("transmitter_resolution", f"""WITH {lens.CELLS}, {lens.SAMPLES}, t AS (SELECT 'c' || cell_id AS cell, cell_id, 'm' || cell_id AS mapping, cell_id % 7 AS pci, channel, ghz, lon, lat FROM lens_cells),
 s AS (SELECT sample_id AS id, CASE sample_id % 8 WHEN 0 THEN 'c' || cell_id WHEN 4 THEN 'm' || cell_id END AS named, CASE WHEN sample_id % 4 = 1 THEN sample_id % 9 END AS pci, CASE WHEN sample_id % 4 IN (1, 3) THEN 'CH-' || (sample_id % 3 + 1) END AS channel, CASE WHEN sample_id % 5 <> 0 THEN ghz END AS ghz, CASE WHEN sample_id % 11 <> 0 THEN lon END AS lon, lat FROM lens_samples),
 x AS (SELECT s.*, min(t.cell) AS by_id FROM s LEFT JOIN t ON s.named = t.cell OR s.named = t.mapping GROUP BY ALL), o AS (SELECT * FROM x WHERE named IS NULL),
 a AS (SELECT o.id, o.lon, o.lat, o.pci, o.channel, o.ghz, count(t.cell) AS n, min(t.cell) AS sole FROM o LEFT JOIN t ON (o.pci IS NULL OR o.pci = t.pci) AND (o.channel IS NULL OR o.channel = t.channel) AND (o.ghz IS NULL OR o.ghz = t.ghz) GROUP BY ALL),
 d AS (SELECT o.id, t.cell, {_D} AS d FROM a o JOIN t ON (o.pci IS NULL OR o.pci = t.pci) AND (o.channel IS NULL OR o.channel = t.channel) AND (o.ghz IS NULL OR o.ghz = t.ghz) WHERE n > 1 AND {_D} <= 250), l AS (SELECT *, min(d) OVER (PARTITION BY id) AS least FROM d),
 k AS (SELECT id, arg_min(cell, (d, cell)) AS cell, count(*) FILTER (d - least < 1e-6) AS k FROM l GROUP BY id),
 r AS (SELECT a.*, k.cell, k, CASE WHEN n = 1 THEN NULL WHEN n = 0 OR lon IS NULL THEN '{matching.NO_PLACE}' WHEN k IS NULL THEN '{matching.NOT_NEAR}' WHEN k > 1 THEN '{matching.TIE}' END AS reason FROM a LEFT JOIN k USING (id))
 SELECT id, by_id AS matched, CASE WHEN by_id IS NOT NULL THEN '{matching.BY_ID}' END AS method, CASE WHEN by_id IS NULL THEN '{matching.NOT_FOUND}' END AS reason FROM x WHERE named IS NOT NULL
 UNION ALL SELECT id, CASE WHEN n = 1 THEN sole WHEN reason IS NULL THEN cell END, CASE WHEN n = 1 THEN '{matching.BY_CELL}' WHEN reason IS NULL THEN '{matching.BY_PLACE}' END, reason FROM r""")
def transmitter_resolution(spark, sf_dir):
    """Every observation's transmitter by its id, by what is known of the cell, or by place, or the reason why none."""
    k, name = F.col("sample_id"), F.col("cell_id").cast("string")
    o = lens.samples(spark, sf_dir).select(
        k.alias("id"), F.when(k % 8 == 0, F.concat(F.lit("c"), name)).otherwise(" ").alias("transmitter_id"), F.when(k % 8 == 4, F.concat(F.lit("m"), name)).alias("serving_id"), F.when(k % 4 == 1, k % 9).alias("pci"),
        F.when((k % 4).isin(1, 3), F.concat(F.lit("CH-"), (k % 3 + 1).cast("string"))).alias("channel"), F.when(k % 5 != 0, F.col("ghz")).alias("ghz"), F.when(k % 11 != 0, F.col("lon")).alias("lon"), "lat",
    )
    t = lens.cells(spark, sf_dir).select(F.concat(F.lit("c"), name).alias("cell_id"), F.concat(F.lit("m"), name).alias("mapping_id"), (F.col("cell_id") % 7).alias("pci"), "channel", "ghz", "lon", "lat")
    return matching.resolved(o, t)


@query("network_map", f"""WITH {lens.CELLS}, {lens.SAMPLES}, e AS (SELECT cell_id AS place, 'o' || (cell_id % 40) AS observed, CASE cell_id % 3 WHEN 0 THEN '28601' WHEN 1 THEN '28602' ELSE '' END AS plmn, cell_id FROM lens_cells), s AS (SELECT sample_id AS id, 'o' || (sample_id % 50) AS cell, '2860' || (sample_id % 4) AS plmn FROM lens_samples)
 SELECT s.id, (SELECT arg_min(e.cell_id, e.place) FROM e WHERE e.observed = s.cell AND (e.plmn = '' OR e.plmn = s.plmn)) AS cell_id FROM s""")
def network_map(spark, sf_dir):
    """The cell that a map gives for an observed cell of a network: the first entry that fits, a blank network fits any."""
    c = F.col("cell_id")
    e = lens.cells(spark, sf_dir).select(c.alias("place"), F.concat(F.lit("o"), (c % 40).cast("string")).alias("observed"), F.when(c % 3 == 0, "28601").when(c % 3 == 1, "28602").otherwise(" ").alias("plmn"), c)
    k = F.col("sample_id")
    s = lens.samples(spark, sf_dir).select(k.alias("id"), F.concat(F.lit("o"), (k % 50).cast("string")).alias("cell"), F.concat(F.lit("2860"), (k % 4).cast("string")).alias("plmn"))
    return matching.mapped(s, e)
