"""Observations matched to transmitters by rules in order: an id, what is known of the cell, the nearest one; and to map entries by network.

Candidates of an observation are never listed. Transmitters are counted by each combination of attributes that observations know, so
one equi-join tells whether there is exactly one; only what stays open meets the transmitters near it.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.functions.numeric import rounded
from meridia.operators.joins import box_join
from meridia.operators.tables import checked_broadcast, shared_table

RADIUS_M, TIE_M = 250.0, 1e-6
_KNOWN = ("pci", "channel", "ghz")
#: How a match was made, and why there is none.
BY_ID, BY_CELL, BY_PLACE = "explicit_id_or_mapping", "pci_channel_frequency", "opt_in_geographic_candidate"
NOT_FOUND, NONE, MANY, NO_PLACE, NOT_NEAR, TIE = (
    "serving_cell_or_mapping_not_found", "no_deterministic_identity_candidate", "multiple_deterministic_candidates",
    "geographic_candidate_requires_observation_coordinate_and_candidates", "no_geographic_candidate_within_radius", "geographic_candidate_tie",
)


def _said(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def resolved(observations: DataFrame, transmitters: DataFrame, geographic: bool = True, radius_m: float = RADIUS_M) -> DataFrame:
    """observations (id, transmitter_id, serving_id, pci, channel, ghz, lon, lat) and transmitters (cell_id, mapping_id, pci, channel, ghz,
    lon, lat) -> (id, matched, method, reason). An id that is given decides alone; else all transmitters with the known attributes count
    (frequencies are equal to six digits), and if not exactly one has them, the nearest of them in the radius; a tie within TIE_M stays open."""
    o = observations.select("id", F.coalesce(_said(F.col("transmitter_id")), _said(F.col("serving_id"))).alias("named"), "pci", _said(F.col("channel")).alias("channel"), rounded(F.col("ghz"), 6).alias("ghz"), "lon", "lat")
    t = transmitters.select("cell_id", "mapping_id", "pci", "channel", rounded(F.col("ghz"), 6).alias("ghz"), F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"))
    names = t.select("cell_id", F.explode(F.array_distinct(F.array("cell_id", F.coalesce("mapping_id", "cell_id")))).alias("named")).groupBy("named").agg(F.min("cell_id").alias("by_id"))
    o = o.join(names, "named", "left")
    open_ = o.where("named IS NULL")
    # a mask says which attributes are known: transmitters are counted for each of the eight
    masks = list(product((False, True), repeat=len(_KNOWN)))
    of = lambda m: F.struct(*(F.when(F.lit(k), F.col(c)).alias(c) for c, k in zip(_KNOWN, m)), F.lit("".join("01"[k] for k in m)).alias("mask"))
    counted = t.select("cell_id", F.explode(F.array(*(of(m) for m in masks))).alias("a")).where(reduce(and_, (~F.substring("a.mask", i + 1, 1).eqNullSafe("1") | F.col(f"a.{c}").isNotNull() for i, c in enumerate(_KNOWN))))
    counted = counted.select("cell_id", F.xxhash64("a").alias("h"), "a").groupBy("h", "a").agg(F.count("*").alias("n"), F.min("cell_id").alias("only"))
    mask = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in _KNOWN))
    asked = open_.select("id", "lon", "lat", *_KNOWN, F.struct(*_KNOWN, mask.alias("mask")).alias("a")).withColumn("h", F.xxhash64("a"))
    asked = asked.join(counted.withColumnRenamed("a", "b"), "h", "left").withColumn("n", F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).select("id", "lon", "lat", *_KNOWN, "n", "only")
    found = o.where("named IS NOT NULL").select("id", F.col("by_id").alias("matched"), F.when(F.col("by_id").isNotNull(), BY_ID).alias("method"), F.when(F.col("by_id").isNull(), NOT_FOUND).alias("reason"))
    one = asked.where("n = 1").select("id", F.col("only").alias("matched"), F.lit(BY_CELL).alias("method"), F.lit(None).cast("string").alias("reason"))
    many = asked.where("n <> 1")
    none = F.lit(None).cast("string")
    if not geographic:
        return found.unionByName(one).unionByName(many.select("id", none.alias("matched"), none.alias("method"), F.when(F.col("n") == 0, NONE).otherwise(MANY).alias("reason")))
    placed = many.where("n > 1 AND lon IS NOT NULL AND lat IS NOT NULL")
    near = box_join(placed, "lon", "lat", t.select("cell_id", *(F.col(c).alias(f"t_{c}") for c in _KNOWN), "t_lon", "t_lat"), geo.bounds_around(F.col("t_lon"), F.col("t_lat"), F.lit(radius_m * 1.01)))
    near = near.where(reduce(and_, (F.col(c).isNull() | F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in _KNOWN))).withColumn("d", geo.distance_m(F.col("t_lon"), F.col("t_lat"), F.col("lon"), F.col("lat"))).where(F.col("d") <= radius_m)
    least = near.withColumn("least", F.min("d").over(Window.partitionBy("id")))
    nearest = least.groupBy("id").agg(F.min_by("cell_id", F.struct("d", "cell_id")).alias("cell_id"), F.count_if(F.col("d") - F.col("least") < TIE_M).alias("k"))
    rest = many.select("id", "n", (F.col("lon").isNotNull() & F.col("lat").isNotNull()).alias("has")).join(nearest, "id", "left")
    reason = F.when((F.col("n") == 0) | ~F.col("has"), NO_PLACE).when(F.col("k").isNull(), NOT_NEAR).when(F.col("k") > 1, TIE)
    rest = rest.select("id", F.when(reason.isNull(), F.col("cell_id")).alias("matched"), F.when(reason.isNull(), BY_PLACE).alias("method"), reason.alias("reason"))
    return found.unionByName(one).unionByName(rest)


def mapped(observations: DataFrame, entries: DataFrame) -> DataFrame:
    """observations (id, cell, plmn) and entries (place, observed, plmn, cell_id) -> (id, cell_id): the first entry for the cell whose network
    is blank (any) or the observation's; null where there is none."""
    e = entries.select("place", F.col("observed").alias("cell"), _said(F.col("plmn")).alias("only"), "cell_id")
    # of the entries of a cell and a network only the first can be the one: observations meet two rows each, not all of their cell's
    first = shared_table(e.groupBy("cell", "only").agg(F.min_by(F.struct("place", "cell_id"), "place").alias("m")).where("m IS NOT NULL"), "firsts")
    of = lambda df, name: checked_broadcast(df.withColumnRenamed("m", name))
    o = observations.select("id", F.when(_said(F.col("cell")).isNotNull(), F.col("cell")).alias("cell"), F.trim("plmn").alias("only"))
    o = o.join(of(first.where("only IS NULL").drop("only"), "blank"), "cell", "left").join(of(first.where("only IS NOT NULL"), "own"), ["cell", "only"], "left")
    return o.select("id", F.when(F.col("blank").isNull() | (F.col("own.place") < F.col("blank.place")), F.col("own.cell_id")).otherwise(F.col("blank.cell_id")).alias("cell_id"))
