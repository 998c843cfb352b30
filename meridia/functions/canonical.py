"""Canonical JSON of any column: the same text for any order of fields, as ECMAScript's JSON.stringify would write it, and its hash.

The expression follows the column's type: fields and map keys are sorted by UTF-16 order of their names (as sorting by code units
does for names without characters beyond the base plane), arrays keep their order, nulls are ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions.identity import content_fingerprint

#: Characters with an escape of their own in JSON.
_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_OTHER = [chr(i) for i in range(32) if chr(i) not in _SHORT]


def text(x: Column) -> Column:
    """A JSON string."""
    out = x
    for c, e in _SHORT.items():
        out = F.replace(out, F.lit(c), F.lit(e))
    rare = out
    for c in _OTHER:
        rare = F.replace(rare, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.concat(F.lit('"'), F.when(F.regexp_like(x, F.lit("[\\x00-\\x1f]")), rare).otherwise(out), F.lit('"'))


def number(x: Column) -> Column:
    """A double as ECMAScript writes it: no exponent from 1e-6 up to 1e21, no trailing zeros; what is no number is null."""
    size = F.abs(x)
    # Java's own text is not always the shortest that gives the number back: one of 15 or 16 digits that does so comes first
    short = [F.upper(F.format_string(f"%.{d}e", size)) for d in (14, 15)]
    said = F.coalesce(*(F.when(t.try_cast("double") == size, t) for t in short), size.cast("string"))
    mantissa, power = F.substring_index(said, "E", 1), F.when(F.contains(said, F.lit("E")), F.substring_index(said, "E", -1).cast("int")).otherwise(0)
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    every = F.concat(whole, part)
    lead = F.length(every) - F.length(F.ltrim(every, F.lit("0")))  # zeros in front
    digits = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
    n = F.length(whole) - lead + power  # where the point is, after n digits
    k = F.length(digits)
    zeros = lambda m: F.repeat(F.lit("0"), m.cast("int"))
    cut = lambda a, b=None: F.substr(digits, a, b) if b is not None else F.substr(digits, a)
    e = n - 1
    tail = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))
    laid = (
        F.when((k <= n) & (n <= 21), F.concat(digits, zeros(n - k))).when((n > 0) & (n <= 21), F.concat(cut(F.lit(1), n), F.lit("."), cut(n + 1)))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), zeros(-n), digits)).when(k == 1, F.concat(digits, tail)).otherwise(F.concat(cut(F.lit(1), F.lit(1)), F.lit("."), cut(F.lit(2)), tail))
    )
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), "null").when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), laid))


def serialised(x: Column, kind: T.DataType, without: frozenset[str] = frozenset()) -> Column:
    """Canonical JSON of a column of this type; fields named in ``without`` are left out at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted((f for f in kind.fields if f.name not in without), key=lambda f: f.name.encode("utf-16-be"))
        parts = [F.concat(text(F.lit(f.name)), F.lit(":"), serialised(x[f.name], f.dataType, without)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: serialised(e, kind.elementType, without)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.filter(F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].cast("string").alias("k"), serialised(e["value"], kind.valueType, without).alias("v")))), lambda e: ~e["k"].isin(*without) if without else F.lit(True))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(text(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        out = x.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        out = number(x.cast("double"))
    elif isinstance(kind, T.IntegralType):
        out = x.cast("string")
    else:
        out = text(x.cast("string"))
    return F.coalesce(out, F.lit("null"))


def fingerprint(x: Column, kind: T.DataType, without: frozenset[str] = frozenset(), prefix: str = "domain-v1") -> Column:
    """The prefix and eight digits of FNV-1a over the UTF-16 units of the canonical JSON."""
    return content_fingerprint(serialised(x, kind, without), prefix)


def sha_fingerprint(x: Column, kind: T.DataType, prefix: str) -> Column:
    """The prefix and 32 digits of the SHA-256 of the canonical JSON."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(serialised(x, kind), 256), 1, 32))
