"""Licences by their real texts and notices: the right one, and the right version of it."""

import os
import textwrap

import pytest

from meridia.llm import license_scan

HERE = "/usr/share/common-licenses"
#: File names of a Debian system -> the licence.
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL": "GFDL-1.3", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL": "GPL-3.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0", "LGPL": "LGPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
PROSE = [f"line {i} of a source file with nothing of interest in it, only names such as x{i} and y{i * 7}" for i in range(20)]


def licences(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license for r in sorted(license_scan.scan(df).collect(), key=lambda r: r.doc_id)]


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no licence texts on this machine")
def test_full_texts(spark):
    """Each as it is, wrapped anew, and inside other text with rights reserved."""
    names = [n for n in FILES if os.path.exists(f"{HERE}/{n}")]
    texts = [open(f"{HERE}/{n}", encoding="utf-8", errors="replace").read() for n in names]
    wrapped = ["\n".join("# " + x for x in textwrap.wrap(t, 60)) for t in texts]
    inside = ["\n".join(["All rights reserved.", *PROSE, t, *PROSE]) for t in texts]
    assert licences(spark, texts + wrapped + inside) == [FILES[n] for n in names] * 3


def test_versions_of_notices(spark):
    later = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
    cases = [(f"{f}-{v if '.' in v else v + '.0'}-or-later", later.format(what=w, name=n, v=v)) for f, n, v, w in [("GPL", "General Public License", "1", "program"), ("GPL", "General Public License", "2", "program"), ("GPL", "General Public License", "3", "file"), ("LGPL", "Lesser General Public License", "2.1", "library"), ("LGPL", "Library General Public License", "2", "library"), ("AGPL", "Affero General Public License", "3", "program")]]
    cases += [("LGPL-2.0", "This work is licensed under the GNU Lesser General Public License, version 2."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.")]
    cases += [("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-ND-2.5", "Licensed under CC BY-NC-ND 2.5."), ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.")]
    cases += [("MIT", "// SPDX-License-Identifier: MIT"), ("GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0-only */\n" + "\n".join(PROSE)), ("LGPL-2.1-or-later", "# SPDX-License-Identifier: LGPL-2.1-or-later"), ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0")]
    cases += [("proprietary", "Copyright Foo. All rights reserved."), ("MIT", "All rights reserved.\nReleased under the MIT License."), (None, "Licensed under the Apache License, Version 7.5."), (None, "This work is licensed under the GNU General Public License, version 9.")]
    wrapped = [("\n".join([*PROSE[:3], *textwrap.wrap(t, 40), *PROSE[3:6]])) for _, t in cases]
    want = [name for name, _ in cases]
    assert licences(spark, [t for _, t in cases]) == want
    assert licences(spark, wrapped) == want


def test_templates_are_distinct_and_carry_their_numbers():
    known = license_scan.known_templates()
    grams = license_scan.template_bigrams(known)
    assert len({tuple(g) for _, g in grams}) == len(known) and [t[:2] for t in known[: len(license_scan.TEMPLATES)]] == list(license_scan.TEMPLATES)
    assert license_scan.numbered(["version 3", "3 of", "of the", "mp3 player"]) == ["version 3", "3 of"]
