"""Pages of an ordered result: offset and limit, how many rows there are in all, and whether more follow.

Ranks come from ranges of the order, so a deep page costs what the first one does, and nothing before it is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.ordered import running


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """rows with place (from 0), number_matched, truncated (more follow) and next_offset (null on the last page); ``order`` must be total.
    A negative offset or limit is an error; an offset behind the last row gives no rows."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit are not negative")
    ranked = running(rows, order, "_rank").where((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit))
    every = rows.agg(F.count("*").alias("number_matched"))
    more = F.col("number_matched") > offset + limit
    out = ranked.join(F.broadcast(every))  # one row
    return out.withColumn("place", F.col("_rank") - 1).withColumn("truncated", more).withColumn("next_offset", F.when(more, offset + limit).cast("long")).drop("_rank")
