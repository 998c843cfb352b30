"""State by client over event time, with timers: rows are taken in order, and state ends when its time is up.

A client's rows wait in its state until the watermark has passed them, so they are taken in the order of their times, whatever
batch they come in; later ones than the watermark allows are dropped by Spark. A timer then folds them over the client's window or
workflow. When nothing waits and the window or workflow has expired, the expiry is emitted and all state of the client is removed,
so what is kept follows the clients that are active, not all there ever were. Sessions are found as in the batch operators.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "session long, line long, began long, n long, event string, cause string, at long"
#: What a row of the result is, and why something expired.
ROW, EXPIRED, IDLE, ABSOLUTE = "row", "expired", "idle", "absolute"

#: Streams' own worker processes may not know where this library is: processors travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Folded(StatefulProcessor):
    """(began, last, n) of a client: a row at ``idle_us`` after the last or ``whole_us`` after the beginning begins anew; None is no limit."""

    def __init__(self, idle_us: int | None, whole_us: int):
        self.idle_us, self.whole_us = idle_us, whole_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "began long, last long, n long")
        self.waiting = handle.getListState("waiting", "us long, line long")
        self.timer = handle.getValueState("timer", "at long")

    def _expiry(self, began: int, last: int) -> tuple[int, str]:
        whole = began + self.whole_us
        idle = whole if self.idle_us is None else last + self.idle_us
        return (idle, IDLE) if idle < whole else (whole, ABSOLUTE)

    def _wake(self, us: int) -> None:
        """A timer for the first millisecond after ``us``; one a client is enough, the earliest."""
        at = us // 1000 + 1
        if self.timer.exists():
            (before,) = self.timer.get()
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(u), int(k)) for part in rows for u, k in zip(part["us"], part["line"])]
        self.waiting.appendList(fresh)
        self._wake(min(u for u, _ in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        session, out = key[0], []
        waiting = sorted((int(u), int(k)) for u, k in self.waiting.get()) if self.waiting.exists() else []
        began, last, n = self.now.get() if self.now.exists() else (None, None, 0)
        due = [w for w in waiting if w[0] < passed]
        for us, line in due:
            if began is not None and us >= self._expiry(began, last)[0]:
                at, cause = self._expiry(began, last)
                out.append((session, None, began, n, EXPIRED, cause, at))
                began = None
            if began is None:
                began, n = us, 0
            last, n = us, n + 1
            out.append((session, line, began, n, ROW, None, us))
        rest = waiting[len(due) :]
        at, cause = self._expiry(began, last) if began is not None else (None, None)
        if at is not None and at < passed and (not rest or rest[0][0] >= at):
            out.append((session, None, began, n, EXPIRED, cause, at))
            began = None
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        if began is None:
            self.now.clear()
        else:
            self.now.update((began, last, n))
            self._wake(at)
        if out:
            yield pd.DataFrame(out, columns=["session", "line", "began", "n", "event", "cause", "at"]).astype({"line": "Int64"})

    def close(self) -> None:
        pass


def _stream(rows: DataFrame, late: str, processor: _Folded) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    slim = rows.select("session", "line", "us", "ts").withWatermark("ts", late)
    return slim.groupBy("session").transformWithStateInPandas(processor, SCHEMA, "Append", "EventTime")


def anchored_budget(rows: DataFrame, width_us: int, late: str = "10 minutes") -> DataFrame:
    """rows (session, line, us, ts) -> SCHEMA: windows that begin with a client's first request after the last one ended; each row's window
    and place, and the end of each window."""
    return _stream(rows, late, _Folded(None, width_us))


def expiring_workflows(rows: DataFrame, idle_us: int, whole_us: int, late: str = "10 minutes") -> DataFrame:
    """rows (session, line, us, ts) -> SCHEMA: workflows that expire when idle, or for good ``whole_us`` after they began; each row's workflow and
    place, and each expiry with its cause."""
    return _stream(rows, late, _Folded(idle_us, whole_us))
