"""Identifiers, fingerprints and lists inside text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and factor of the 32-bit FNV-1a hash.
FNV_START, FNV_PRIME = 2166136261, 16777619
MOST_TOWERS, MOST_TOWER_BYTES = 64, 128
MOST_SPAN_M = 50_000.0


def fingerprint(columns: dict[str, Column], digits: int = 16) -> Column:
    """The first digits of the SHA-256 of name=value pairs, in order of the names; null differs from every text."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.concat(F.lit(":"), columns[k].cast("string")), F.lit(""))) for k in sorted(columns)]
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, digits)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text (a character beyond the base plane is two), as a number."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), (F.length(digits) / 4).cast("int")), lambda i: F.conv(F.substr(digits, (4 * i - 3).cast("int"), F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.length(digits) > 0, units).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(units, F.lit(FNV_START).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * FNV_PRIME, F.lit(1 << 32)))


def content_fingerprint(text: Column, prefix: str = "domain-v1") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(F.lower(F.hex(fnv1a(text))), 8, "0"))


def bounded(text: Column, most: int) -> Column:
    """A text of more than ``most`` bytes becomes its beginning, a dash and twelve digits of its SHA-256.

    A prefix of n characters is taken where n is the most whose bytes fit: bytes of prefixes are a running sum over the characters.
    """
    room = most - 13
    fits = F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes")),
        lambda a, c: F.when(a["bytes"] + F.octet_length(c) <= room, F.struct((a["n"] + 1).alias("n"), (a["bytes"] + F.octet_length(c)).alias("bytes"))).otherwise(F.struct(a["n"].alias("n"), F.lit(room + 1).alias("bytes"))),
        lambda a: a["n"],
    )
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.substr(text, F.lit(1), fits), F.lit("-"), F.substring(F.sha2(text, 256), 1, 12)))


def positive_integer(text: Column) -> Column:
    """A text as a positive 64-bit whole number (``5``, ``5.0``, ``5e2``), or null."""
    number = F.trim(text).try_cast("decimal(38,9)")
    return F.when((number > 0) & (number == F.floor(number)) & (number <= 9223372036854775807), number).cast("long")


def tower_ids(text: Column) -> Column:
    """(ids, problem) of a comma-separated list: blanks cut, empty parts left out, each id once in order of first sight."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    problem = F.when(F.size(parts) > MOST_TOWERS, "too_many").when(F.exists(parts, lambda x: F.octet_length(x) > MOST_TOWER_BYTES), "id_too_long")
    return F.struct(F.when(problem.isNull(), F.array_distinct(parts)).alias("ids"), problem.alias("problem"))


def tower_locations(text: Column, ids: Column) -> Column:
    """Places (id, lon, lat) of ``id:lon:lat;...``, of listed ids only; entries that are no numbers are left out."""

    def one(entry: Column) -> Column:
        part = F.split(entry, ":", 3)
        at = lambda i: F.get(part, F.lit(i))
        return F.struct(F.trim(at(0)).alias("id"), at(1).try_cast("double").alias("lon"), at(2).try_cast("double").alias("lat"))

    entries = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), one)
    return F.filter(entries, lambda e: F.array_contains(ids, e["id"]) & e["lon"].isNotNull() & e["lat"].isNotNull())


def bounding_box(text: Column, most_m: float = MOST_SPAN_M) -> Column:
    """(min_lon, min_lat, max_lon, max_lat, problem) of ``a,b,c,d``."""
    from meridia.functions import geo

    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), ",")
    n = [F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in range(4)]
    good = (n[0] < n[2]) & (n[1] < n[3]) & (n[0] >= -180) & (n[2] <= 180) & (n[1] >= -90) & (n[3] <= 90)
    problem = (
        F.when(F.size(parts) != 4, "four_numbers_required").when(n[0].isNull() | n[1].isNull() | n[2].isNull() | n[3].isNull(), "invalid_coordinate")
        .when(~good, "invalid_bounds").when(geo.distance_m(n[0], n[1], n[2], n[3]) > most_m, "too_wide")
    )
    return F.struct(*(F.when(problem.isNull(), x).alias(k) for k, x in zip(("min_lon", "min_lat", "max_lon", "max_lat"), n)), problem.alias("problem"))
