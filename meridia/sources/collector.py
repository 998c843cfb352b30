r"""Signal-collector exports: a versioned text with a header and tab-separated rows, escaped by backslashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first line, the columns, and the escapes of the format.
FORMAT = "SIGNAL_COLLECTOR_TXT_V6"
COLUMNS = ("timestamp_iso_utc", "epoch_ms", "elapsed_realtime_ns", "session_id", "sequence_number", "source", "payload")
ESCAPES = {"\\t": "\t", "\\r": "\r", "\\n": "\n", "\\;": ";", "\\=": "="}
_SOUND = r"^(?:[^\\]|\\[\\;=trn])*$"
SKEW_MS = 2000


def unescape(text: Column) -> Column:
    """Escapes resolved; doubled backslashes are set aside first, so they can't pair with what follows."""
    out = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for code, char in ESCAPES.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def payload(text: Column) -> Column:
    """A map of ``k=v;k=v``; of a repeated key the last value; null if an escape or a pair is malformed."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"((?:\\.|[^\\;])+)"), F.lit(1)), lambda p: F.trim(p) != "")
    key = lambda p: F.regexp_extract(p, r"^((?:\\.|[^\\=])*)=", 1)
    pairs = F.transform(parts, lambda p: F.struct(unescape(key(p)).alias("k"), unescape(F.substr(p, F.length(key(p)) + 2)).alias("v")))
    sound = text.rlike(_SOUND) & F.forall(parts, lambda p: p.rlike(r"^(?:\\.|[^\\=])*=")) & F.forall(pairs, lambda e: F.trim(e["k"]) != "")
    last = F.filter(F.transform(pairs, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: ~F.exists(F.slice(pairs, e["i"] + 2, F.greatest(F.size(pairs) - e["i"] - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    return F.when(sound, F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"]))))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of exports, gzip ones too; a file is one row before it is split, as its lines are numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("i", "text")).select("file", (F.col("i") + 1).alias("line"), "text")


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows, issues and header: (file, line, columns, payload map, skew_ms), (file, line, code), (file, key, value)."""
    heads = lines.where(F.col("text").startswith("timestamp_iso_utc\t")).groupBy("file").agg(F.min("line").alias("head"))
    known = lines.where((F.col("line") == 1) & (F.regexp_replace("text", "^﻿", "") == FORMAT)).select("file")
    marked = lines.join(known, "file", "left_semi").join(heads, "file")
    header = marked.where((F.col("line") > 1) & (F.col("line") < F.col("head")) & F.col("text").contains("=")).select("file", F.substring_index("text", "=", 1).alias("key"), F.regexp_replace("text", "^[^=]*=", "").alias("value"))
    fields = F.regexp_extract_all("text", F.lit(r"(?:^|\t)((?:\\.|[^\\\t])*)"), F.lit(1))
    data = marked.where((F.col("line") > F.col("head")) & (F.trim("text") != "")).withColumn("f", fields)
    at = lambda k: F.try_element_at(F.col("f"), F.lit(k + 1))
    data = data.select("file", "line", F.size("f").alias("n"), "f", *((at(i) if i == 6 else unescape(at(i))).alias(c) for i, c in enumerate(COLUMNS)))
    whole = {c: F.col(c).try_cast("long") for c in ("epoch_ms", "elapsed_realtime_ns", "sequence_number")}
    stamp = F.try_to_timestamp("timestamp_iso_utc")
    sound = F.forall(F.slice("f", 1, 6), lambda x: x.rlike(_SOUND))
    code = (
        F.when(F.col("n") != 7, "malformed_row").when(~sound, "malformed_escape").when(whole["epoch_ms"].isNull() | whole["elapsed_realtime_ns"].isNull() | whole["sequence_number"].isNull(), "invalid_timestamp_or_sequence")
        .when(stamp.isNull(), "invalid_timestamp").when(payload(F.col("payload")).isNull(), "malformed_payload")
    )
    data = data.withColumn("code", code)
    rows = data.where("code IS NULL").select("file", "line", "timestamp_iso_utc", *(v.alias(k) for k, v in whole.items()), "session_id", "source", payload(F.col("payload")).alias("payload"), (F.unix_millis(stamp) - whole["epoch_ms"]).alias("skew_ms"))
    late = rows.where(F.abs("skew_ms") > SKEW_MS).select("file", "line", F.lit("timestamp_epoch_mismatch").alias("code"))
    return rows, data.where("code IS NOT NULL").select("file", "line", "code").unionByName(late), header


#: Connection states of a serving cell, and the quantities of a cell row.
SERVING = ("PRIMARY_SERVING", "SECONDARY_SERVING")
QUANTITIES = ("rsrp", "rsrq", "rssi", "rssnr")


def cells(rows: DataFrame) -> DataFrame:
    """Cell rows of a parsed log: technology, identity, channel, frequency, whether serving, and the group of cells seen at once."""
    tag = lambda k: F.nullif(F.trim(F.try_element_at(F.col("payload"), F.lit(k))), F.lit(""))
    c = rows.where(F.try_element_at("payload", F.lit("record_type")) == "cell")
    tech = F.lower(tag("technology"))
    serving = F.coalesce(F.lower(tag("registered")) == "true", F.lit(False)) & F.coalesce(F.upper(tag("connection_status")).isin(*SERVING), F.lit(False))
    return c.select(
        "file", "line", "session_id", "epoch_ms", tech.alias("technology"), F.when(tech == "nr", F.coalesce(tag("nci"), tag("cell_id"))).otherwise(tag("cell_id")).alias("cell_id"), tag("plmn").alias("plmn"), tag("pci").try_cast("int").alias("pci"),
        F.coalesce(tag("earfcn"), tag("nrarfcn")).try_cast("int").alias("channel"), (tag("frequency_mhz").try_cast("double") / 1000).alias("ghz"), serving.alias("serving"), F.coalesce(tag("cell_timestamp_ms").try_cast("long"), F.col("epoch_ms")).alias("seen_ms"), "payload",
    )


def quantities(cell_rows: DataFrame) -> DataFrame:
    """One row for each measured quantity of a cell row; texts that are no number are left out."""
    pairs = F.array(*(F.struct(F.lit(q).alias("quantity"), F.try_element_at(F.col("payload"), F.lit(q)).try_cast("double").alias("value")) for q in QUANTITIES))
    return cell_rows.select("file", "line", "cell_id", "serving", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("q")).select("file", "line", "cell_id", "serving", "q.quantity", "q.value")


def readiness(cell_rows: DataFrame, least: int = 20) -> DataFrame:
    """By quantity and frequency: rows, serving rows, distinct cells, and what keeps them from being used for validation."""
    q = quantities(cell_rows).join(cell_rows.select("file", "line", "ghz"), ["file", "line"])
    g = q.groupBy("quantity", "ghz").agg(F.count("*").alias("n"), F.count_if("serving").alias("n_serving"), F.count_distinct("cell_id").alias("cells"))
    blockers = F.array(F.when(F.col("ghz").isNull(), "frequency_unknown"), F.when(F.col("n_serving") == 0, "no_serving_rows"), F.when(F.col("n") < least, "too_few_rows"))
    return g.withColumn("blockers", F.filter(blockers, lambda b: b.isNotNull()))
