"""Building tags: lengths, levels, heights, materials, and demand scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag texts that mean "nothing", and scores by tag.
MISSING = ("", "no", "none", "nan", "null", "<na>", "n/a", "na")
AMENITIES = {"cafe": 50, "hospital": 70, "university": 65, "clinic": 50, "school": 50, "restaurant": 50}
SHOPS = {"mall": 100, "supermarket": 80, "department_store": 100}
DEMAND_BUILDINGS = {"commercial": 45, "retail": 40, "office": 35, "school": 45, "university": 60, "hospital": 70, "dormitory": 30, "public": 20}
RESIDENTIAL_BUILDINGS = {"apartments": 24, "residential": 20, "house": 12, "detached": 10, "semidetached_house": 10, "terrace": 12, "dormitory": 25}
NAME_KEYWORDS = {"avm": 100, "alışveriş": 90, "alisveris": 90, "mall": 100, "hastane": 70, "hospital": 70, "üniversite": 65, "universite": 65, "university": 65, "okul": 50, "school": 50, "tower": 45, "plaza": 45}
MATERIALS = {"glass": ("glass",), "brick": ("brick",), "wood": ("wood", "timber"), "metal": ("metal", "steel"), "concrete": ("concrete", "cement", "stone")}
STOREY_M, TALLEST_M, DEFAULT_M, FOOT_M = 3.0, 500.0, 9.0, 0.3048


def clean(tag: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    return F.when(low.isin(*MISSING), "").otherwise(low)


def positive(text: Column) -> Column:
    x = F.trim(text).try_cast("double")
    return F.when((x > 0) & (x < float("inf")) & ~F.isnan(x), x)


def length_m(text: Column) -> Column:
    """Metres of "12", "12 m", "40 ft" or "30'"; null unless between 1 and 500."""
    low = F.lower(F.trim(text))
    feet = low.rlike(r"(ft|feet|')$")
    bare = F.regexp_replace(low, r"\s*(meters|metres|meter|metre|m|feet|ft|')$", "")
    metres = positive(bare) * F.when(feet, FOOT_M).otherwise(1.0)
    return F.when(metres.between(1.0, TALLEST_M), metres)


def height(height_tag: Column, levels_tag: Column) -> Column:
    """Struct (height_m, evidence): an observed tag, else storeys, else the default of three storeys."""
    seen, n = length_m(height_tag), positive(levels_tag)
    storeys = F.when(n.isNotNull(), F.least(n * STOREY_M, F.lit(TALLEST_M)))  # least() alone would skip the null
    evidence = F.when(seen.isNotNull(), "observed_tag").when(storeys.isNotNull(), "derived_from_levels").otherwise("unavailable")
    return F.struct(F.coalesce(seen, storeys, F.lit(DEFAULT_M)).alias("height_m"), evidence.alias("evidence"))


def material(*tags: Column) -> Column:
    """The material that the first telling tag names."""

    def of(tag: Column) -> Column:
        low, out = F.lower(F.coalesce(tag, F.lit(""))), F.lit(None).cast("string")
        for name, words in reversed(MATERIALS.items()):
            out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), name).otherwise(out)
        return out

    return F.coalesce(*map(of, tags), F.lit("unknown"))


def levels(tag: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(tag, F.lit("")), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def lookup(table: dict[str, int], key: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, float(v))))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(0.0))


def area_score(square_m: Column) -> Column:
    return F.when(square_m >= 20_000, 30.0).when(square_m >= 10_000, 20.0).when(square_m >= 5_000, 10.0).otherwise(0.0)


def _profile(parts: list[tuple[Column, Column, int]], nothing: str) -> Column:
    """Struct (score, reason, confidence) of scored reasons; only those with a positive score count."""
    live = F.filter(F.array(*(F.struct(s.cast("double").alias("s"), r.alias("r"), F.lit(c).alias("c")) for s, r, c in parts)), lambda p: p["s"] > 0)
    score = F.aggregate(live, F.lit(0.0), lambda a, p: a + p["s"])
    rank = F.coalesce(F.array_max(F.transform(live, lambda p: p["c"])), F.lit(0))
    reason = F.when(F.size(live) > 0, F.array_join(F.transform(live, lambda p: p["r"]), "|")).otherwise(nothing)
    return F.struct(score.alias("score"), reason.alias("reason"), F.element_at(F.array(*map(F.lit, ("none", "low", "medium", "high"))), rank + 1).alias("confidence"))


def demand(building: Column, amenity: Column, shop: Column, office: Column, name: Column, square_m: Column) -> Column:
    b, a, s, o, n = map(clean, (building, amenity, shop, office, name))
    word = F.element_at(F.concat(F.filter(F.array(*map(F.lit, NAME_KEYWORDS)), lambda w: F.contains(n, w)), F.array(F.lit(""))), 1)
    say = lambda kind, x: F.concat(F.lit(f"{kind}:"), x)
    return _profile(
        [
            (lookup(SHOPS, s), say("shop", s), 3),
            (lookup(AMENITIES, a), say("amenity", a), 3),
            (F.when(o != "", 35.0).otherwise(0.0), say("office", o), 3),
            (lookup(DEMAND_BUILDINGS, b), say("building", b), 3),
            (lookup(NAME_KEYWORDS, word), say("name", word), 2),
            (area_score(square_m), F.concat(F.lit("large_footprint:"), F.rint(square_m).cast("long").cast("string"), F.lit("m2")), 1),
        ],
        "generic",
    )


def residential(building: Column, levels_tag: Column, density: Column, nearby: Column, nearby_homes: Column) -> Column:
    b, storeys = clean(building), levels(levels_tag)
    home, generic = b.isin(*RESIDENTIAL_BUILDINGS), b == "yes"
    settled = generic & (nearby >= 18) & (nearby_homes >= 4)
    shown = F.regexp_replace(storeys.cast("string"), r"\.0$", "")
    return _profile(
        [
            (lookup(RESIDENTIAL_BUILDINGS, b), F.concat(F.lit("residential:"), b), 3),
            (F.when(home & storeys.isNotNull(), F.least(storeys * 2.0, F.lit(80.0))), F.concat(F.lit("residential_levels:"), shown), 3),
            (F.when(home & (density >= 25), F.least(density * 0.25, F.lit(30.0))), F.lit("density:residential_cluster"), 2),
            (F.when(settled, F.least(8 + nearby * 0.25 + nearby_homes * 1.5, F.lit(40.0))), F.lit("generic_dense_settlement"), 2),
            (F.when(generic & ~settled & (nearby >= 35), F.least(nearby * 0.15, F.lit(12.0))), F.lit("density:built_cluster"), 1),
        ],
        "none",
    )


def weight(building: Column, levels_tag: Column, office: Column, amenity: Column, shop: Column) -> Column:
    b = clean(building)
    return (
        1.0
        + F.coalesce(levels(levels_tag) * 2, F.lit(0.0))
        + F.when(b.isin("residential", "apartments"), 5.0).otherwise(0.0)
        + F.when((b == "commercial") | (clean(office) != ""), 20.0).otherwise(0.0)
        + F.when(clean(amenity).isin(*AMENITIES), 50.0).otherwise(0.0)
        + F.when(clean(shop).isin(*SHOPS), 100.0).otherwise(0.0)
    )
