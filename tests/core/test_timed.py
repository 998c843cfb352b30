"""Streams with timers: rows in order whatever batch they come in, expiries emitted, state gone afterwards."""

import random

import pytest
from pyspark.sql import functions as F

from meridia.streaming import timed

SECOND = 1_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def plain(rows, idle, whole, until):
    """Rows of each client in order of time, and what expires before ``until``."""
    out = []
    for session in sorted({s for s, _, _ in rows}):
        began = last = None
        n = 0

        def expiry():
            return min((last + idle, "idle") if idle is not None else (float("inf"), ""), (began + whole, "absolute"), key=lambda x: (x[0], x[1] != "absolute"))

        for us, line in sorted((u, k) for s, k, u in rows if s == session):
            if began is not None and us >= expiry()[0]:
                out.append((session, None, began, n, "expired", expiry()[1], expiry()[0]))
                began = None
            if began is None:
                began, n = us, 0
            last, n = us, n + 1
            out.append((session, line, began, n, "row", None, us))
        if expiry()[0] < until:
            out.append((session, None, began, n, "expired", expiry()[1], expiry()[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["budget", "workflows"])
def test_streamed_rows_are_those_in_order(spark, tmp_path, kind):
    rnd = random.Random(7)
    rows, line, now = [], 0, 0
    for _ in range(160):
        now += rnd.choice([1, 2, 5, 40, 90]) * SECOND
        rows.append((rnd.randrange(5), line, now + rnd.randrange(1000)))
        line += 1
    files = [[] for _ in range(6)]
    for i, r in enumerate(rows):  # up to 60 rows out of order, far less than the watermark allows
        files[min(5, i * 6 // len(rows) + rnd.randrange(2))].append(r)
    last = now + 10**12
    files.append([(99, line, last)])  # time goes on: all others expire
    for i, part in enumerate(files):
        rnd.shuffle(part)
        df = spark.createDataFrame(part, "session long, line long, us long").withColumn("ts", F.timestamp_micros("us"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    idle, whole = (None, 120 * SECOND) if kind == "budget" else (60 * SECOND, 200 * SECOND)
    stream = spark.readStream.schema("session long, line long, us long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    before = spark.conf.get(PROVIDER)
    try:
        out = timed.anchored_budget(stream, whole, "2 hours") if kind == "budget" else timed.expiring_workflows(stream, idle, whole, "2 hours")
        q = out.writeStream.format("memory").queryName(f"timed_{kind}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination(120)
        got = sorted((tuple(r) for r in spark.table(f"timed_{kind}").collect()), key=repr)
        assert got == [r for r in plain(rows, idle, whole, last) if r[0] != 99]
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
        assert max(kept) > 10 and kept[-1] <= 3  # what the last client waits with
    finally:
        spark.conf.set(PROVIDER, before)
