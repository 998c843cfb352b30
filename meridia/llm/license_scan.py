r"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams. DataFrame operations only.

Units of comparison are each line of a text and the text as a whole. A unit is lower-cased, everything but letters and
digits becomes a blank, and its set of word bigrams is compared to a template's. As Dice is 2|A n B| / (|A| + |B|), it
can reach the threshold t only if |A| lies between |B| t / (2 - t) and |B| (2 - t) / t; templates outside these bounds
are never compared, and a text without any of the templates' anchor words is not taken apart. Everything happens inside a
row: nothing is shuffled.

Notices that are wrapped over lines, or share a line with other words, are found by windows: runs of at most as many
bigrams as a template's bound allows, over the whole text, that begin and end with a bigram of the template (a longer
window around the same bigrams has a smaller coefficient). A window decides a text's license only if its coefficient is
above that of every line and of the whole. Read by their start, windows that overlap the last one are the same unit; units
of windows that touch a matching line are that line. A text that matches as a whole has no windows to count.

Versions decide: a unit must hold every bigram of a template that has a number in it. The titles of full licence texts and SPDX
tags outrank notices, which outrank the reservation of all rights; among equals the coefficient decides, then the longer template. A licence of
which no title, notice or tag is listed is not found.

Defined results: a text without a match (null and empty ones too) has a null license, dice 0, template -1 and no license units; equal
coefficients go to the longest template, then to the first of the list; repeated rows get equal results; other columns are never looked at.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Words that many texts have ("mit" as the German "with"): taken as anchors only where nothing else is left.
COMMON = frozenset("0 2 3 4 a all and any are as at be by can for free from if in is it may mit not of or out project that the this to under use v version was with without work you".split())
#: Public license notices, as (SPDX id, wording).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("proprietary", "All rights reserved."),
)
#: What full licence texts begin with, or say in one place only.
TITLES = (
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.1", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Artistic-1.0", "The \"Artistic License\" Preamble The intent of this document is to state the conditions under which a Package may be copied"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission."),
)
#: Names and versions of licence families, and the tags that stand for them.
GNU = (("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Library General Public License", ("2",)), ("LGPL", "GNU Lesser General Public License", ("2", "2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
CC_VERSIONS = (("1.0", None), ("2.0", None), ("2.5", None), ("3.0", "Unported"), ("4.0", "International"))
TAGS = ("MIT", "ISC", "Unlicense", "Zlib", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-1.1", "MPL-2.0", "EPL-2.0", "Artistic-1.0", "Artistic-2.0", "CC0-1.0", "GFDL-1.2-only", "GFDL-1.3-only")
RESERVED, NOTICE, TITLE = 0, 1, 2


def known_templates() -> list[tuple[str, str, int]]:
    """(SPDX id, wording, rank): the listed notices first, then those of every version of the families, titles and tags."""
    out = [(name, wording, RESERVED if name == "proprietary" else NOTICE) for name, wording in TEMPLATES]
    full = lambda v: v if "." in v else f"{v}.0"
    for family, name, versions in GNU:
        for v in versions:
            out.append((f"{family}-{full(v)}", f"This work is licensed under the {name}, version {v}.", NOTICE))
            out.append((f"{family}-{full(v)}-or-later", f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.", NOTICE))
    for kind, name in CC:
        for v, port in CC_VERSIONS:
            out.append((f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.", NOTICE))
            if port:
                out.append((f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {name} {v} {port} License.", NOTICE))
    out.append(("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.', NOTICE))
    out.append(("BSD-2-Clause", "Released under the BSD 2-Clause License.", NOTICE))
    out += [(name, wording, TITLE) for name, wording in TITLES]
    tags = [*TAGS, *(f"{f}-{full(v)}{end}" for f, _, versions in GNU for v in versions for end in ("", "-only", "-or-later")), *(f"CC-{kind}-{v}" for kind, _ in CC for v, _ in CC_VERSIONS)]
    out += [(tag, f"SPDX-License-Identifier: {tag}", TITLE) for tag in dict.fromkeys(tags)]
    once: dict[str, tuple[str, str, int]] = {}
    for t in out:
        once.setdefault(re.sub(r"[\W_]+", " ", t[1].lower()).strip(), t)
    return list(once.values())


def numbered(grams: list[str]) -> list[str]:
    """The bigrams that hold a number: those a unit must have."""
    return [g for g in grams if any(w[0].isdigit() for w in g.split())]


def template_bigrams(templates) -> list[tuple[str, list[str]]]:
    out = []
    for name, wording, *_ in templates:
        words = re.sub(r"[\W_]+", " ", wording.lower()).split()
        out.append((name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))))
    return out


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The sizes of bigram sets whose Dice with a set of ``size`` can reach the threshold."""
    t = Fraction(str(threshold))  # exact: a bound that a rounding error moves would lose templates
    return ceil(size * t / (2 - t)), floor(size * (2 - t) / t)


def _bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a normalised unit."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.when(n >= 2, F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(F.split(F.trim(unit), " ")), of_words)[0]


def anchors(known: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold has one: those of a template cover more bigrams than a unit may lack."""
    out: list[str] = []
    for _, grams in known:
        lack, open_ = len(grams) - bounds(len(grams), threshold)[0], list(grams)
        chosen = set()
        while len(grams) - len(open_) <= lack:
            words = sorted({w for g in open_ for w in g.split()})
            word = max(words, key=lambda w: (w not in COMMON, w in out, sum(w in g.split() for g in open_), len(w), w))
            chosen.add(word)
            open_ = [g for g in open_ if word not in g.split()]
        out += sorted(chosen - set(out))
    return out


def _bind(value: Column, body) -> Column:
    """The array body(value), with value computed once."""
    return F.flatten(F.transform(F.array(value), body))


def _windows(text: Column, table: Column, every: Column, threshold: float) -> Column:
    """Of a normalised text the matching windows: the best one of each first bigram and template, as (dice, i, name, start, end)."""

    def of_template(grams: Column, t: Column) -> Column:
        def from_first(places: Column, k: Column) -> Column:
            start = F.element_at(places, k)
            ends = F.filter(F.slice(places, k + t["lo"] - 1, t["hi"]), lambda e: e - start < t["hi"])

            def score(e: Column) -> Column:
                unit = F.array_distinct(F.slice(grams, start, e - start + 1))
                dice = F.lit(2.0) * F.size(F.array_intersect(unit, t["grams"])) / (F.size(unit) + t["n"])
                whole = F.size(F.array_except(t["must"], unit)) == 0
                return F.struct(t["rank"].alias("rank"), F.when(whole, dice).otherwise(0.0).alias("dice"), t["n"].alias("n"), (-t["i"]).alias("i"), t["name"].alias("name"), start.alias("start"), e.alias("end"))

            return F.array_max(F.filter(F.transform(ends, score), lambda x: x["dice"] >= threshold))

        def all_of(places: Column) -> Column:
            first = F.filter(F.sequence(F.lit(1), F.size(places) - t["lo"] + 1), lambda k: F.element_at(places, k + t["lo"] - 1) - F.element_at(places, k) < t["hi"])
            return F.filter(F.transform(first, lambda k: from_first(places, k)), lambda x: x.isNotNull())

        return _bind(F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(t["grams"], F.element_at(grams, i))), all_of)

    def of_grams(grams: Column) -> Column:
        near = lambda shared: F.filter(table, lambda t: F.size(F.array_intersect(t["grams"], shared)) >= t["lo"])
        return _bind(F.array_intersect(every, grams), lambda shared: F.flatten(F.transform(near(shared), lambda t: of_template(grams, t))))

    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return _bind(F.split(F.trim(text), " +"), lambda w: _bind(pairs(w), of_grams))


def _matching_lines(normal: Column, best_of) -> Column:
    """The places (a, b) of the first and last word of each matching line, counted over the text."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("lines"))

    def step(held: Column, line: Column) -> Column:
        end = held["at"] + F.size(F.filter(F.split(line, " "), lambda w: w != ""))
        own = F.array(F.struct((held["at"] + 1).alias("a"), end.alias("b")))
        return F.struct(end.alias("at"), F.when(best_of(line).isNull(), held["lines"]).otherwise(F.concat(held["lines"], own)).alias("lines"))

    return F.aggregate(F.split(normal, "\n"), none, step)["lines"]


def _apart(windows: Column, lines: Column) -> Column:
    """How many notices the windows are, without those that touch a matching line; one that overlaps the last notice is the same, and a better one takes its place."""
    by_start = F.array_sort(F.transform(windows, lambda x: F.struct(x["start"].alias("start"), (-x["dice"]).alias("less"), (-x["end"]).alias("back"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("less"))

    def upto(held: Column) -> Column:
        outside = (held["start"] > 0) & ~F.exists(lines, lambda r: (held["start"] <= r["b"]) & (held["end"] + 1 >= r["a"]))
        return held["n"] + outside.cast("int")

    def step(held: Column, x: Column) -> Column:
        is_new = x["start"] > held["end"]
        better = is_new | (x["less"] < held["less"])
        n = F.when(is_new, upto(held)).otherwise(held["n"])
        return F.struct(n.alias("n"), F.when(better, x["start"]).otherwise(held["start"]).alias("start"), F.when(better, -x["back"]).otherwise(held["end"]).alias("end"), F.when(better, x["less"]).otherwise(held["less"]).alias("less"))

    return F.aggregate(by_start, none, step, upto)


def scan(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, template (its place in the list, or -1), n_license_units of each row of docs. ``templates`` are (name,
    wording) or (name, wording, rank), notices where no rank is given; None for ``known_templates``."""
    templates = known_templates() if templates is None else templates
    known = template_bigrams(templates)
    ranks = [t[2] if len(t) > 2 else NOTICE for t in templates]
    strings = lambda some: F.array(*map(F.lit, some)) if some else F.array().cast("array<string>")
    sizes = [bounds(len(grams), threshold) for _, grams in known]
    least, most = min(a for a, _ in sizes), max(b for _, b in sizes)
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(ranks[i]).alias("rank"), strings(grams).alias("grams"), strings(numbered(grams)).alias("must")) for i, ((name, grams), (lo, hi)) in enumerate(zip(known, sizes))))

    def best(grams: Column) -> Column:
        """Of a bigram set: the largest (rank, dice, size, -template, license) of the candidate templates that reach the threshold, or null."""
        fits = F.filter(table, lambda t: (F.size(grams) >= t["lo"]) & (F.size(grams) <= t["hi"]) & (F.size(F.array_except(t["must"], grams)) == 0))
        scored = F.transform(fits, lambda t: F.struct(t["rank"].alias("rank"), (F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])).alias("dice"), t["n"].alias("n"), (-t["i"]).alias("i"), t["name"].alias("name")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

    def best_of(unit: Column) -> Column:
        return F.transform(F.array(_bigrams(unit)), best)[0]

    # every unit that reaches the threshold has an anchor: the other texts are not taken apart at all
    words = anchors(known, threshold)
    lower = F.lower(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower.alias("lower"))
    rows = rows.select("doc_id", F.when(reduce(or_, (F.contains("lower", F.lit(w)) for w in words)), F.regexp_replace("lower", r"[^\p{L}\p{N}\n]+", " ")).otherwise(F.lit("")).alias("normal"))
    whole = F.translate("normal", "\n", " ")
    framed = F.concat(F.lit(" "), whole, F.lit(" "))
    rows = rows.select("doc_id", F.when(reduce(or_, (F.contains(framed, F.lit(f" {w} ")) for w in words)), F.col("normal")).otherwise(F.lit("")).alias("normal"))
    lines = F.filter(F.split("normal", "\n"), lambda x: F.length(x) >= 2 * least + 1)
    units = F.filter(F.transform(F.concat(lines, F.array(whole)), _bigrams), lambda g: F.size(g).between(least, most))
    hits = F.filter(F.transform("units", best), lambda h: h.isNotNull())
    possible = F.col("normal") != ""
    rows = rows.select("doc_id", "normal", F.array_contains(F.array(F.lit(0)), F.instr("normal", "\n")).alias("single"), F.when(possible, units).otherwise(F.array().cast("array<array<string>>")).alias("units")).select("doc_id", "normal", "single", hits.alias("hits"))
    # in a text of one line the line and the whole are the same unit
    count = F.when(F.col("single") & (F.size("hits") > 0), 1).otherwise(F.size("hits"))
    every = F.array(*map(F.lit, dict.fromkeys(g for _, grams in known for g in grams)))
    windows = F.when(possible, _windows(whole, table, every, threshold))
    rows = rows.select("doc_id", "normal", "single", F.array_max("hits").alias("line"), count.cast("long").alias("count"), windows.alias("windows"))
    lines = F.when(F.col("count") > 0, _matching_lines(F.col("normal"), best_of)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    inside = F.when(F.coalesce(F.size("windows"), F.lit(0)) < 1, 0).when((F.col("count") > 0) & (F.col("single") | best_of(whole).isNotNull()), 0).otherwise(_bind(lines, lambda x: F.array(_apart(F.col("windows"), x)))[0])
    window = F.array_max("windows")
    above = (window["rank"] > F.col("line.rank")) | ((window["rank"] == F.col("line.rank")) & (window["dice"] > F.col("line.dice")))
    same = F.struct(*(window[c].alias(c) for c in ("rank", "dice", "n", "i", "name")))
    top = F.when(window.isNotNull() & (F.col("line").isNull() | above), same).otherwise(F.col("line"))
    rows = rows.select("doc_id", top.alias("top"), (F.col("count") + inside).cast("long").alias("n_license_units"))
    return rows.select("doc_id", F.col("top.name").alias("license"), F.coalesce("top.dice", F.lit(0.0)).alias("dice"), F.coalesce(-F.col("top.i"), F.lit(-1)).alias("template"), "n_license_units")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_templates()
    listed = lambda some: f"[{', '.join(map(quoted, some))}]::VARCHAR[]"
    rows = ",\n".join(f"({i}, {quoted(name)}, {known[i][2]}, {len(grams)}, {lo}, {hi}, {listed(grams)}, {listed(numbered(grams))})" for i, (name, grams) in enumerate(template_bigrams(known)) for lo, hi in [bounds(len(grams), THRESHOLD)])
    return rf"""
    WITH t(i, name, rank, n, lo, hi, grams, must) AS (VALUES {rows}),
    d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS normal FROM documents),
    u AS (SELECT doc_id, unnest(CASE WHEN contains(normal, chr(10)) THEN list_append(string_split(normal, chr(10)), replace(normal, chr(10), ' ')) ELSE [normal] END) AS unit FROM d),
    w AS (SELECT doc_id, string_split(trim(unit), ' ') AS w, row_number() OVER () AS k FROM u),
    g AS (SELECT doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS g FROM w WHERE len(w) >= 2),
    s AS (SELECT doc_id, k, i, name, rank, n, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + n) AS dice FROM g JOIN t ON len(g) BETWEEN lo AND hi WHERE list_has_all(g, must)),
    h AS (SELECT doc_id, k, max(dice) AS unit_dice FROM s WHERE dice >= {THRESHOLD} GROUP BY doc_id, k),
    b AS (SELECT doc_id, i, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, dice DESC, n DESC, i) AS r FROM s WHERE dice >= {THRESHOLD}) WHERE r = 1)
    SELECT doc_id, name AS license, coalesce(dice, 0.0::DOUBLE) AS dice, coalesce(i, -1)::INTEGER AS template, coalesce(c, 0)::BIGINT AS n_license_units
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS c FROM h GROUP BY doc_id) USING (doc_id)"""


SQL = _sql()
