"""Running sums and followers against a plain sort, with ties in all but the last key, and over empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from meridia.operators.ordered import followed, running


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_running_and_followed(spark, n):
    rnd = random.Random(7)
    rows = [(rnd.choice([None, 0, 0, 0, 1, 2, 3]), i, rnd.randint(0, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(7)
    order = [F.asc_nulls_first("a"), F.desc("b")]
    plain = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -r[1]))
    assert {(r.a, r.b): r.k for r in running(df, order, "k").collect()} == {(a, b): i for i, (a, b, _) in enumerate(plain, 1)}
    upto, want = 0, {}
    for a, b, v in plain:
        upto += v
        want[b] = upto
    assert {r.b: r.s for r in running(df, order, "s", F.col("v")).collect()} == want
    line = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    got = {r.b: r.next and (r.next.a, r.next.v) for r in followed(df, ["a", "b"], ["a", "v"]).collect()}
    assert got == {r[1]: (line[i + 1][0], line[i + 1][2]) if i + 1 < n else None for i, r in enumerate(line)}


def test_pages(spark):
    from meridia.operators.paging import page

    df = spark.range(0, 230).selectExpr("id * 7 % 230 AS k")
    seen, offset = [], 0
    while offset is not None:
        rows = sorted(page(df, ["k"], offset, 100).collect(), key=lambda r: r.place)
        assert all(r.number_matched == 230 and r.truncated == (offset < 130) for r in rows) and [r.place for r in rows] == list(range(offset, min(230, offset + 100)))
        seen += [r.k for r in rows]
        offset = rows[0].next_offset
    assert seen == list(range(230)) and page(df, ["k"], 500, 10).count() == 0 == page(df.where("false"), ["k"]).count()


def test_gates_of_a_calibration(spark):
    from pyspark.sql import functions as F

    from meridia.operators import stats

    df = spark.range(0, 200).selectExpr("id AS sample_id", "32.0 + id * 0.0002 AS lon", "40.0D AS lat", "6.0 + id % 5 AS residual")
    said = lambda d, *a: stats.calibration(d, *a).first()
    good = said(df)
    assert good.eligible and good.adjustment == 8.0 == good.total_offset and good.mae_after < good.mae_before and good.n == 200
    assert said(df.where("sample_id < 19")).reason == "too_few_samples" and said(df.where("false")).reason == "too_few_samples"
    assert said(df.withColumn("lon", F.lit(32.0))).reason == "spatial_diversity"
    assert said(df, 33.0).reason == "out_of_range" and said(df, 0.0, True).reason == "expired"
    bad = said(df.withColumn("residual", F.when(F.col("sample_id") % 2 == 0, 1.0).otherwise(-1.0)))
    assert bad.reason == "no_improvement" and bad.adjustment is None
