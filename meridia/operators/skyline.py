"""Skyline: the rows that no other row dominates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.tables import checked_broadcast, shared_table

#: Vectors of the front that may be broadcast.
FRONT_ROWS = 200_000


def maximal(x: np.ndarray) -> np.ndarray:
    """The rows of complete, distinct vectors (higher is better) that none dominates.

    In falling order of the columns a row can be dominated by earlier ones only, and then by one of the front.
    """
    if x.shape[1] == 0:
        return x[:1]
    x = np.unique(x, axis=0)[::-1]
    front = np.empty_like(x)
    n = 0
    for row in x:
        if not (front[:n] >= row).all(1).any():
            front[n] = row
            n += 1
    return front[:n]


def _merged(parts: Iterator[pd.DataFrame], names: list[str]) -> dict[tuple[bool, ...], np.ndarray]:
    """The front of each pattern of known dimensions, in these dimensions only."""
    held: dict[tuple[bool, ...], np.ndarray] = {}
    for part in parts:
        x = part[names].to_numpy(np.float64)
        known = ~np.isnan(x)
        for pattern in np.unique(known, axis=0):
            rows = x[(known == pattern).all(1)][:, pattern]
            key = tuple(bool(k) for k in pattern)
            held[key] = maximal(np.concatenate([held[key], rows]) if key in held else rows)
    return held


def _beaten(rows: np.ndarray, own: tuple[bool, ...], fronts: dict[tuple[bool, ...], np.ndarray]) -> np.ndarray:
    """Which rows of one pattern a row of another pattern dominates in the dimensions that both know."""
    out = np.zeros(len(rows), bool)
    for other, front in fronts.items():
        shared = [i for i in range(len(own)) if own[i] and other[i]]
        if other == own or not shared:
            continue
        a = rows[:, [sum(own[:i]) for i in shared]]
        b = maximal(front[:, [sum(other[:i]) for i in shared]])
        for i in np.flatnonzero(~out):
            out[i] = ((b >= a[i]).all(1) & (b > a[i]).any(1)).any()
    return out


def skyline(df: DataFrame, better: dict[str, str]) -> DataFrame:
    """Rows of df not dominated in ``better`` ({column: "max" or "min"}), equal rows all kept.

    A dimension that either row lacks (null or NaN) is skipped. Dominance is then not transitive, but it is among rows
    that lack the same dimensions, and what a dominated row beats, the one above it beats too: so fronts are kept by
    pattern of known dimensions, per partition and then together, and only the last step compares patterns. Only distinct
    vectors of the fronts meet in one task; rows, equal ones included, are joined to the vectors at the end.
    """
    sign = [F.col(c).cast("double") * (1 if way == "max" else -1) for c, way in better.items()]
    names = [f"_s{i}" for i in range(len(sign))]
    rows = df.withColumns({n: F.when(~F.isnan(s), s) for n, s in zip(names, sign)})

    def table(fronts: dict[tuple[bool, ...], np.ndarray]) -> Iterator[pd.DataFrame]:
        for pattern, front in fronts.items():
            full = np.full((len(front), len(names)), np.nan)
            full[:, np.array(pattern, bool)] = front
            yield pd.DataFrame(full, columns=names)

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from table(_merged(parts, names))

    def last(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fronts = _merged(parts, names)
        yield from table({p: f[~_beaten(f, p, fronts)] for p, f in fronts.items()})

    schema = ", ".join(f"{n} double" for n in names)
    front = rows.select(*names).mapInPandas(local, schema).repartition(1).mapInPandas(last, schema)
    front = shared_table(front.toDF(*(f"{n}f" for n in names)), "front")
    same = reduce(and_, (F.col(n).eqNullSafe(F.col(f"{n}f")) for n in names))
    return rows.join(checked_broadcast(front, FRONT_ROWS), same, "left_semi").drop(*names)
