"""State carried along the rows of each key, in order, where no window function can say it.

Rows are dealt by key and sorted inside tasks, and a task runs through its Arrow batches once: what it holds is the state of
one key, not the key's rows. A key's rows do pass through one task, as each state depends on the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, tuple]], added: str) -> DataFrame:
    """df with the columns ``added`` that ``step(state, row)`` gives for each row of a key, in ``order``; ``start()`` is a key's first state."""
    extra = StructType.fromDDL(added)
    names = [f.name for f in extra.fields]
    schema = StructType([*df.schema.fields, *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = None, None, True
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if first or key != now:
                    now, state, first = key, start(), False
                state, values = step(state, row)
                out.append(values)
            columns = list(zip(*out)) if out else [()] * len(names)
            made = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, extra.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def anchored_windows(width: int, ts: str) -> tuple[Callable, Callable]:
    """Windows of ``width`` that begin with the first row after the last one ended: (window's begin, place in it) of each row."""

    def step(state, row):
        began, n = state
        if began is None or row[ts] >= began + width:
            began, n = row[ts], 0
        return (began, n + 1), (began, n + 1)

    return (lambda: (None, 0)), step


def workflows(idle: int, absolute: int, ts: str) -> tuple[Callable, Callable]:
    """Workflows that end after ``idle`` without a row, or ``absolute`` after they began: (begin, place in it) of each row."""

    def step(state, row):
        began, last, n = state
        if began is None or row[ts] >= last + idle or row[ts] >= began + absolute:
            began, n = row[ts], 0
        return (began, row[ts], n + 1), (began, n + 1)

    return (lambda: (None, None, 0)), step
