"""Links put in order: which chain an element belongs to, and its place there, by pointer doubling.

``links`` (a, b) say that b follows a; an element has at most one follower and at most one that it follows, so the links are
open chains and rings. In round k every element knows who stands 2^k places before it, so a chain of n elements takes
log2(n) rounds of one join, and no chain is ever held in one task. A ring has no first element: it begins at its smallest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.tables import drop_tables, shared_table


def chains(links: DataFrame) -> DataFrame:
    """(a, b) -> (element, chain, place, closed): ``chain`` is the first element, ``place`` counts from 0. Elements may be of any
    type that can be compared. Links that are null at either end count for nothing, repeated ones once."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    ends = links.select(F.col("a").alias("e")).unionByName(links.select(F.col("b").alias("e"))).distinct()
    before = links.select(F.col("b").alias("e"), F.col("a").alias("at"))
    low = F.struct(F.col("e").alias("id"), F.lit(0).cast("long").alias("steps"))
    first = F.col("at").isNull()
    state = ends.join(before, "e", "left").select(
        "e", F.coalesce("at", "e").alias("at"), F.when(first, 0).otherwise(1).cast("long").alias("steps"), first.alias("ended"),
        F.when(first, low).otherwise(F.least(low, F.struct(F.col("at").alias("id"), F.lit(1).cast("long").alias("steps")))).alias("low"),
    )
    state = shared_table(state, "chains")
    while True:
        far = state.select(F.col("e").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("ended").alias("_ended"), F.col("low").alias("_low"))
        further = F.struct(F.col("_low.id").alias("id"), (F.col("steps") + F.col("_low.steps")).alias("steps"))
        moved = state.where("NOT ended").join(far, "at").select("e", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_ended").alias("ended"), F.least("low", further).alias("low"), ((F.least("low", further) != F.col("low")) | F.col("_ended")).alias("moved"))
        fresh = shared_table(state.where("ended").withColumn("moved", F.lit(False)).unionByName(moved), "chains")
        drop_tables(state)
        state = fresh.drop("moved")
        state._meridia_path = fresh._meridia_path
        # all windows of a ring have the same smallest element once none changes any more
        if fresh.where("moved").isEmpty():
            break
    place = F.when(F.col("ended"), F.col("steps")).otherwise(F.col("low.steps"))
    return state.select(F.col("e").alias("element"), F.when(F.col("ended"), F.col("at")).otherwise(F.col("low.id")).alias("chain"), place.alias("place"), (~F.col("ended")).alias("closed"))
