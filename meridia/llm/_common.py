"""What the operators share: reading tables, shared-folder tables, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from meridia.operators.tables import BROADCAST_ROWS, at_most, checked_broadcast, drop_tables, new_folder, remove_at_exit, shared_dir  # noqa: F401
from meridia.operators.tables import shared_table as stage_table  # noqa: F401

#: Words are maximal runs of anything but the six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Characters of text that a Python kernel holds at a time (one longer text is held whole).
SLICE_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about SLICE_CHARS bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            held += n or 0
            if held >= SLICE_CHARS:
                yield batch.slice(begin, i + 1 - begin)
                begin, held = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000: a row here may be a long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
