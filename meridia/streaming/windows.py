"""Log operators over streams: windows with watermarks, sessions, and state by session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_budget(events: DataFrame, key: str, ts: str, window: str = "60 seconds", most: int = 20, late: str = "10 minutes") -> DataFrame:
    """Requests of a client in fixed windows, and whether they exceed the budget."""
    w = events.withWatermark(ts, late).groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n", (F.col("n") > most).alias("over_budget"))


def sliding_totals(events: DataFrame, key: str, ts: str, value: str, window: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(key, F.window(ts, window, slide).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(key, F.col("w.start").alias("began"), "n", "total")


def follow_ups(events: DataFrame, key: str, ts: str, idle: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Workflows that end after some idle time."""
    w = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, idle).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def latest(events: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The newest row of each key by ``ts``, whatever the order of arrival; for update or complete output."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_row")).select(*keys, "_row.*")


def _workflow_state(fresh):
    """Rows of a client folded over its state (begin, last, count): a row begins a new window where ``fresh(state, at)``."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        began, last, n = state.get if state.exists else (None, None, 0)
        out = []
        for r in pd.concat(list(parts)).sort_values(["us", "line"]).itertuples():
            at = int(r.us)
            if began is None or fresh(began, last, at):
                began, n = at, 0
            last, n = at, n + 1
            out.append((key[0], int(r.line), began, n))
        state.update((began, last, n))
        yield pd.DataFrame(out, columns=["session", "line", "began", "n"])

    return step


def _folded_stream(rows: DataFrame, fresh) -> DataFrame:
    from pyspark.sql.streaming.state import GroupStateTimeout

    return rows.groupBy("session").applyInPandasWithState(_workflow_state(fresh), "session long, line long, began long, n long", "began long, last long, n long", "append", GroupStateTimeout.NoTimeout)


def anchored_budget(rows: DataFrame, width_us: int) -> DataFrame:
    """(session, line, began, n) of rows (session, line, us): windows that begin with a client's first request after the last one."""
    return _folded_stream(rows, lambda began, last, at: at >= began + width_us)


def expiring_workflows(rows: DataFrame, idle_us: int, whole_us: int) -> DataFrame:
    """(session, line, began, n): workflows that expire when idle, or for good ``whole_us`` after they began."""
    return _folded_stream(rows, lambda began, last, at: at >= last + idle_us or at >= began + whole_us)


_OUT = "session long, line long, epoch_ms long, lon double, point string, clock_back boolean"
_STATE = "lon double, point string, until_ms long, elapsed long"


def replay(rows: DataFrame, hold_ms: int = 3_600_000) -> DataFrame:
    """A log's state by session: last position, active survey point (for ``hold_ms``), clock steps back.

    rows: session, line, epoch_ms, elapsed_ns, fix_lon, point. In a micro-batch rows are taken by line; the batch twin
    orders by line over the whole log, so results agree if lines do not arrive in a later batch than their followers.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lon, point, until, elapsed = state.get if state.exists else (None, None, None, None)
        out = []
        for r in pd.concat(list(parts)).sort_values("line").itertuples():
            if not pd.isna(r.fix_lon):
                lon = float(r.fix_lon)
            if not pd.isna(r.point):
                point, until = r.point, int(r.epoch_ms) + hold_ms
            live = point if until is not None and r.epoch_ms <= until else None
            out.append((key[0], r.line, r.epoch_ms, lon, live, elapsed is not None and r.elapsed_ns < elapsed))
            elapsed = int(r.elapsed_ns)
        state.update((lon, point, until, elapsed))
        yield pd.DataFrame(out, columns=["session", "line", "epoch_ms", "lon", "point", "clock_back"])

    return rows.groupBy("session").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
