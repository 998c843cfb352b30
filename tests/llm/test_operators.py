"""Each operator against a plain version, on odd rows, and on an empty table."""

import hashlib
import re
import textwrap
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from meridia.llm import _shingles, best_fit_pack, chat_format, embedding_dedup, importance_sample, language_id, license_scan, ngram_jaccard, quality_rules, queries, source_mix, token_binary

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
LONG_WORDS = " ".join(f"w{i} \n" for i in range(200))


def rows_of(df):
    return [tuple(None if v is pd.NA or (isinstance(v, float) and v != v) else v for v in r) for r in df]


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def against_sql(df, sql, **tables):
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame.toArrow())
    columns = sorted(df.columns)
    mine = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    theirs = sorted(map(repr, c.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))
    assert mine == theirs


def unique(docs):
    return docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


# quality rules


def plain_repeat(w, k=8):
    grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    often = {g for g in grams if grams.count(g) > 1}
    return len({i + j for i, g in enumerate(grams) if g in often for j in range(k)})


def test_repeated_words_is_exact():
    rng = np.random.default_rng(1)
    for n in (0, 3, 8, 9, 40, 200):
        w = [bytes([97 + x]) for x in rng.integers(0, 2, n)]
        assert quality_rules.repeated_words(w, 8) == plain_repeat(w)


def test_quality_rules(spark, docs, no_docs):
    got = {(r.doc_id, r.n_words) for r in quality_rules.score(docs).collect()}
    assert {(r.doc_id, len(words(r.text))) for r in docs.collect()} == got
    assert quality_rules.score(docs).count() == docs.count()
    assert quality_rules.score(no_docs).count() == 0 == quality_rules.keep(no_docs).count()
    against_sql(quality_rules.score(unique(docs)), quality_rules.SQL, documents=unique(docs))
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    judged = {r.doc_id for r in quality_rules.score(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == judged and 5 in judged and 1 not in judged


def test_cascade_orders_by_rejections_per_cost(spark, docs):
    found = quality_rules.estimate(docs, quality_rules.BASE_RULES + quality_rules.STYLE_RULES)
    assert [e.gain for e in found] == sorted((e.gain for e in found), reverse=True)
    assert all(e.texts == docs.count() for e in found)


# language


def test_language_features_do_not_depend_on_chunks(monkeypatch):
    made = language_id.Features()
    text = "Ein Wort, zwei Wörter und 3 Zahlen. " * 20
    whole = made.counts(text)
    for size in (7, 50, 101):
        monkeypatch.setattr(language_id, "CHUNK", size)
        assert (made.counts(text) == whole).all()


def test_language_id(spark, docs, no_docs):
    got = language_id.query(docs).collect()
    assert len(got) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 11))
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert language_id.query(no_docs).count() == 0
    nobody = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.query(nobody).collect()} == {"und"}
    assert language_id.keep(docs).columns == docs.columns


def test_language_id_on_held_out_texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.query(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_language_sample_is_bounded_and_complete(spark):
    """One id and one text make most rows; there are more labels than 1,000; a rerun fits the same machines."""
    hot = [(-7, "ein langer satz mit vielen worten", "de")] * 300
    rare = [(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {'abcdefgh'[i % 8] * 5}", f"x{i}") for i in range(1100)]
    df = spark.createDataFrame(hot + rare, "doc_id long, text string, lang string")
    small = language_id.fit(df.where("doc_id < 5"), per_language=3)
    assert small.langs == ["de", "x0", "x1", "x2", "x3", "x4"]
    again = language_id.fit(df.where("doc_id < 5").repartition(7), per_language=3)
    assert (small.weights == again.weights).all()

    class Counted:
        def __init__(self, x, langs):
            self.n, self.langs = len(x), langs

    real, language_id.Model = language_id.Model, Counted
    try:
        made = language_id.fit(df)
    finally:
        language_id.Model = real
    assert made.n == 1101 and len(set(made.langs)) == 1101


def test_predictions_do_not_depend_on_neighbours(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    model, made = language_id.fit(df), language_id.Features()
    counts = [made.counts(r.text) for r in df.collect()]
    assert model.predict(counts) == [model.predict([c])[0] for c in counts] and model.predict([None]) == [("und", 0.0)]


def test_language_keep_writes_the_prediction(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    said = {r.doc_id: (r.lang_pred, r.score) for r in language_id.query(df).collect()}
    kept = {r.doc_id: r.lang for r in language_id.keep(df).collect()}
    assert kept == {i: lang for i, (lang, score) in said.items() if lang != "und" and score >= language_id.LEAST_SCORE}
    assert len(kept) >= 0.98 * df.count()


# mixing


def plain_mix(rows):
    """(id, size, source) of unique ids -> copies of each id, by the rule of the docstring, without Spark."""
    by = {}
    for i, n, g in rows:
        by.setdefault(g, []).append((i, n))
    names = sorted(by, key=lambda g: (g is None, g or ""))
    weight = {g: (3.0, 1.0, 2.0)[k % 3] for k, g in enumerate(names)}
    size = {g: sum(n for _, n in by[g]) for g in names}
    closed = set()
    while True:
        free = [g for g in names if g not in closed]
        words, open_ = 1.5 * sum(size.values()) - sum(2.0 * size[g] for g in closed), sum(weight[g] for g in free)
        more = {g for g in free if 2.0 * size[g] * open_ < weight[g] * words}
        if not more:
            break
        closed |= more
    out = {}
    for g in names:
        target = 2.0 * size[g] if g in closed else min(2.0 * size[g], weight[g] * words / open_)
        whole = int(target // size[g]) if size[g] else 0
        left = target - whole * size[g]
        p = left / size[g] if size[g] else 0.0
        mean = size[g] / max(1, sum(n > 0 for _, n in by[g])) or 1.0
        x = {i: int(1024.0 * n / (n + mean)) for i, n in by[g]}
        x_mean = sum(n * x[i] for i, n in by[g]) / size[g] if size[g] else 0.0
        ranked = []
        for i, n in by[g]:
            u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            pi = p + min(p, 1 - p) * (x_mean - x[i]) / 1024.0
            if n and p > 0:
                ranked.append((min(u * (1 - pi) / (u * (1 - pi) + pi * (1 - u)), 1 - 2.0**-52), i, n))
        ranked.sort()
        taken, room = set(), int(left)
        for _ in range(source_mix.PASSES):
            held = 0
            for _, i, n in ranked:
                if i not in taken and n <= room:
                    if held + n > room:
                        break
                    held += n
                    taken.add(i)
            room -= held
        rest = [(abs(n - room), k, i) for k, i, n in ranked if i not in taken and abs(n - room) < room]
        taken |= {min(rest)[2]} if rest else set()
        out.update({i: (whole + (i in taken)) * bool(n) for i, n in by[g]})
    return out


def test_mix_against_a_plain_version(spark):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(["w"] * int(n)), None if i % 9 == 0 else f"s{i % 4}") for i, n in enumerate(np.concatenate([rng.integers(0, 60, 150), [900, 2500, 4000]]))]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    want = plain_mix([(i, len(words(t)), g) for i, t, g in texts])
    assert {r.doc_id: r.copies for r in source_mix.mix(df).collect()} == want
    assert {r.doc_id: r["count"] for r in source_mix.keep(df).groupBy("doc_id").count().collect()} == {i: n for i, n in want.items() if n}


def test_mix_keeps_rows_of_one_id_apart(spark):
    """One id in many rows and sources: a row is written as often as the mix takes it."""
    rows = [(1, " ".join(["w"] * n), f"s{n % 3}", "x") for n in range(1, 20)] + [(1, "a b", "s0", "y"), (1, "a b", "s0", "z"), (None, "c d e", None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    mixed = source_mix.mix(df)
    assert source_mix.keep(df).count() == mixed.agg({"copies": "sum"}).first()[0] and mixed.where("copies > 2").count() == 0
    assert source_mix.keep(df).columns == df.columns


def test_mix_includes_short_documents_more_often(spark):
    """Inclusion frequencies by length: unequal inside a source, each near the mean of the stated probabilities."""
    texts = [(i, " ".join(["w"] * (4 if i % 2 else 40)), "abc"[i % 3]) for i in range(1800)]
    got = source_mix.mix(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()
    open_ = 0
    for g in "abc":
        own = [r for r in got if r.source == g]
        whole, p = divmod(own[0].target / own[0].source_size, 1)
        x = {n: int(1024 * n / (n + own[0].source_size / len(own))) for n in (4, 40)}
        mean = sum(r.size * x[r.size] for r in own) / own[0].source_size
        for n in (4, 40):
            share = np.mean([r.copies - whole for r in own if r.size == n])
            assert abs(share - (p + min(p, 1 - p) * (mean - x[n]) / 1024)) < 0.09
        if 0.2 < p < 0.8:
            open_ += 1
            assert np.mean([r.copies for r in own if r.size == 4]) > np.mean([r.copies for r in own if r.size == 40]) + 0.05
    assert open_


def test_source_mix(spark, docs, no_docs):
    assert source_mix.query(no_docs).count() == 0
    got = source_mix.query(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    against_sql(source_mix.query(unique(docs)), source_mix.SQL, documents=unique(docs))
    assert sorted(map(repr, source_mix.query(docs).collect())) == sorted(map(repr, got))
    kept = source_mix.keep(unique(docs))
    assert kept.columns == docs.columns
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in source_mix.query(unique(docs)).collect()}
    assert {k: v for k, v in taken.items() if v} == {r.doc_id: r.n for r in kept.groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}


def test_mix_comes_near_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = source_mix.mix(d).toPandas().groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert ((got.taken - got.target).abs() <= 0.02 * got.source_size).all()
    assert abs(got.target.sum() - 1.5 * got.source_size.sum()) < 1


# licenses


def test_license_scan(spark, docs, no_docs):
    assert license_scan.scan(no_docs).count() == 0
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[15].license == "MIT" and got[15].dice == 1.0 and got[1].license is None and got[4].n_license_units == 0
    against_sql(license_scan.scan(unique(docs)), license_scan.SQL, documents=unique(docs))


def test_license_bounds_lose_nothing():
    t = 0.8
    for n in range(1, 60):
        lo, hi = license_scan.bounds(n, t)
        for a in range(1, 120):
            best = 2 * min(a, n) / (a + n)
            assert (best >= t - 1e-12) == (lo <= a <= hi)


def test_license_notices_that_are_wrapped_or_embedded(spark):
    word = {name: wording for name, wording in license_scan.TEMPLATES if len(wording) > 120}
    prose = [f"line {i} of a source file with nothing of interest in it, only names such as x{i} and y{i * 7}" for i in range(60)]
    wrap = lambda text, mark="": [mark + x for x in textwrap.wrap(text, 70)]
    mit = "The MIT License (MIT)\n\nCopyright (c) 2024 Foo\n\n" + "\n".join(wrap(word["MIT"])) + "\n\nThe above copyright notice shall be included in all copies."
    texts = {
        "MIT": [mit, "Released under the MIT License. See the file LICENSE for details.", "\n".join(prose + wrap(word["MIT"]) + prose)],
        "Apache-2.0": ["\n".join(wrap(word["Apache-2.0"], "# ") + prose), "Copyright 2024 Foo Inc. Licensed under the Apache License, Version 2.0. Made in many towns by very many people."],
        "GPL-3.0-or-later": ["\n".join([prose[0], *wrap(word["GPL-3.0-or-later"], " * "), *prose])],
        "GPL-2.0": ["This work is licensed under the GNU General Public License,\nversion 2.\n" + "\n".join(prose)],
        None: ["\n".join(prose), "The general public may work under the license of any version of the software. " * 40],
    }
    rows = [(name, text, 1) for name, some in texts.items() for text in some if name]
    rows += [(None, text, 0) for text in texts[None]]
    rows += [("MIT", "\n".join(prose[:9] + wrap(word["MIT"]) + prose + wrap(word["GPL-3.0-or-later"]) + prose), 2), ("MIT", "Released under the MIT License.\n" + "\n".join(prose + wrap(word["MIT"])), 2)]
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert {i: r.license for i, r in got.items()} == {i: r[0] for i, r in enumerate(rows)}
    assert {i: r.n_license_units for i, r in got.items()} == {i: r[2] for i, r in enumerate(rows)}


def test_license_anchors_lose_nothing():
    known = license_scan.template_bigrams(license_scan.known_templates())
    words_ = license_scan.anchors(known, 0.8)
    for _, grams in known:
        free = sum(not any(w in g.split() for w in words_) for g in grams)
        assert free < license_scan.bounds(len(grams), 0.8)[0]


# n-gram Jaccard


def plain_sets(texts):
    out = []
    for text in texts:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def plain_components(ids, sets):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_pigeonhole_shares_a_signature_with_every_partner():
    rng = np.random.default_rng(5)
    heat = rng.integers(0, 4, 1 << ngram_jaccard.COST_BITS).astype(np.uint64)
    for n in [*range(1, 40), 59, 60, 61, 74, 75, 119, 120, 150, 333, 1000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            gone = int(rng.integers(0, n // 5 + 1))
            new = int(rng.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, new, np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                assert np.intersect1d(ngram_jaccard.signatures(a, heat), ngram_jaccard.signatures(b, heat)).size, (len(a), len(b))


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(6)
    for n in (5, 100, 2000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**64, n // 3, np.uint64)]))
        bits = sum(int(x).bit_count() for x in (_shingles.parity(a) ^ _shingles.parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_word_hashes_do_not_depend_on_parts(monkeypatch):
    texts = ["One two\tthree", None, "", LONG_WORDS, "x" * 300, " one  TWO ", "é ß"]
    want = [[whole.of(w)[0] for w in words(t)] for t in texts] if (whole := _shingles.WordHashes()) else []
    monkeypatch.setattr(_shingles.WordHashes, "LIMIT", 64)
    small = _shingles.WordHashes()
    for made in (whole, small):
        assert [list(x) for x in made.of_many(texts)] == want


def test_ngram_jaccard(spark, docs, no_docs):
    assert ngram_jaccard.components(no_docs).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.components(docs).collect()}
    plain = unique(docs).collect()
    ids, sets = [r.doc_id for r in plain], plain_sets([r.text for r in plain])
    comp = plain_components(ids, sets)
    assert {k: v for k, v in got.items() if k is not None} == {i: (len(s), comp[i]) for i, s in zip(ids, sets)}
    assert ngram_jaccard.components(docs).count() == docs.count()
    kept = ngram_jaccard.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == {i for i in ids if comp[i] == i}


def test_ngram_jaccard_on_chains_and_groups(spark):
    """Groups of near copies whose members are partly below the threshold among each other, and a passage all share."""
    rng = np.random.default_rng(2)
    texts = []
    passage = [f"p{i}" for i in range(30)]
    for group in range(6):
        base = [f"g{group}w{x}" for x in rng.integers(0, 5000, 80)]
        for _ in range(25):
            w = list(base)
            for at in rng.integers(0, 80, int(rng.integers(0, 4))):
                w[at] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    for i in range(60):
        texts.append(" ".join(passage + [f"u{i}x{j}" for j in range(int(rng.integers(3, 25)))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.components(df).collect()}
    assert got == plain_components(list(range(len(texts))), plain_sets(texts))


def test_ngram_jaccard_with_null_ids_first_in_buckets(spark):
    """Two near copies of a text without an id: each bucket of the two has the third, which in some groups comes first."""
    rows = []
    for group in range(15):
        base = [f"g{group}w{i}" for i in range(200)]
        rows.append((None, " ".join(base)))
        rows += [(2 * group + k, " ".join([*base[:at], f"n{at}", *base[at + 1 :]])) for k, at in enumerate((50, 150))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.components(df).collect() if r.doc_id is not None}
    assert got == {i: i - i % 2 for i in range(30)}


def test_ngram_keep_on_repeated_rows(spark):
    """One row of a group stays, whatever ids and rows repeat; an id's other text is a document of its own."""
    one, near, other = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = one.replace("a30", "zz")
    rows = [(1, one, "p"), (1, one, "p"), (1, one, "q"), (2, near, "p"), (1, other, "p"), (3, other, "p"), (None, one, "p"), (4, "", "p"), (4, "", "p"), (5, None, "p"), (None, "only here as a text of its own", "p")]
    kept = ngram_jaccard.keep(spark.createDataFrame(rows, "doc_id long, text string, extra string"))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert got == sorted([(False, 1, one), (False, 1, other), (False, 4, ""), (False, 4, ""), (False, 5, ""), (True, 0, "only here as a text of its own")]) and kept.columns == ["doc_id", "text", "extra"]


def test_ngram_jaccard_in_crowded_buckets(spark, monkeypatch):
    """All signatures taken as crowded, few pivots a round: the result is the same."""
    rng = np.random.default_rng(12)
    texts = []
    for group in range(3):
        base = [f"g{group}w{x}" for x in rng.integers(0, 5000, 90)]
        for _ in range(30):
            w = list(base)
            for at in rng.integers(0, 90, int(rng.integers(0, 5))):
                w[at] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ngram_jaccard, "CROWDED", 0)
    monkeypatch.setattr(ngram_jaccard, "PIVOTS", (("label", 1), ("cls", 8)))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.components(df).collect()}
    assert got == plain_components(list(range(len(texts))), plain_sets(texts))


# embeddings


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in centre[i % 8] + rng.normal(size=16) * 0.12], i % 3, "x") for i in range(300)]
    rows += [(300, None, 1, "x"), (301, [0.0] * 16, 1, "x"), (302, [float("nan")] * 16, 1, "x"), (303, rows[0][1], None, "x"), (304, [1.0, 2.0], 1, "x"), (305, [2.0, 4.0], 1, "x"), (306, [], 1, "x"), (307, rows[0][1], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")
    exact = embedding_dedup.near_duplicates(df)
    v = [(i, np.array(e, np.float32).astype(float), l) for i, e, l, _ in rows if e and l is not None and np.isfinite(e).all() and np.any(e)]
    links, root = dict.fromkeys((r[0] for r in rows), 0), {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a, x), (j, b, y) in combinations(v, 2):
        if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            links[i], links[j] = links[i] + 1, links[j] + 1
            p, q = top(i), top(j)
            root[max(p, q)] = min(p, q)
    want = {i: (links[i], top(i), top(i) == i) for i in links}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in exact.collect()} == want
    blocks = embedding_dedup.near_duplicates(df, block=37)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in blocks.collect()} == want
    cells = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, cell_rows=40).collect()}
    assert sum(cells.values()) >= 0.9 * sum(links.values()) and all(cells[i] <= links[i] for i in links)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_in_a_hot_group_of_many_cells(spark):
    """A third of the rows are near copies (pairwise cosine about 0.95), cut into far more cells than one; the rest has no clusters."""
    rng = np.random.default_rng(9)
    n, dim = 3000, 64
    noise = rng.normal(size=(n, dim))
    v = noise.copy()
    v[: n // 3] = rng.normal(size=dim) / 8 + noise[: n // 3] * np.sqrt((1 / 0.95 - 1) / dim)
    v = v.astype(np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, [float(e) for e in x], 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    for block in (4096, 150):
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, cell_rows=30, block=block).collect()}
        assert want.sum() > 500_000 and sum(got.values()) == want.sum() and all(got[i] == k for i, k in enumerate(want))


def test_embedding_equal_vectors_and_repeated_ids(spark):
    one, two, far = [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]
    rows = [(i, one, 1) for i in (5, 6, 7, 8)] + [(9, two, 1), (10, far, 1), (11, one, 2), (12, one, 2), (13, far, 1), (13, far, 2), (13, far, 1), (14, None, 1), (14, None, 1), (None, one, 1), (None, one, 1)]
    got = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (4, 5, i == 5) for i in (5, 6, 7, 8, 9)}, 10: (1, 10, True), 13: (1, 10, False), 11: (1, 11, True), 12: (1, 11, False), 14: (0, 14, True), None: (0, None, True)}


# chats


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string")


ODD = [(1, 0, "system", "be <s> nice", "x"), (1, 1, "user", "a\\[INST] b [/INST]</s>", "x"), (1, 2, "assistant", "x\\\\ <</SYS>>\n", "x"), (2, 0, None, None, "x"), (2, 1, "user", None, "x"), (3, 5, "assistant", "b", "x"), (3, 5, "assistant", "a", "x"), (3, 5, "assistant", "a", "x"), (4, None, "tool[ROLE]", "[/ROLE]x", "x"), (None, 1, "user", "hi", "x"), (5, 1, "assistant", "été \U0001f600", "x"), (6, 0, "user", "[INST] [INST] x [/INST]", "x"), (6, 1, "assistant", "[INST] x [/INST]", "x")]


def test_chat_format(spark):
    df = chats(spark, ODD)
    got = {r.conv_id: r for r in chat_format.query(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None, -1}
    by = {}
    for c, t, r, x, _ in ODD + [(-1, 0, "user", "</s>[INST] ok [/INST]", ""), (-1, 1, "assistant", "</s>[INST] ok [/INST]", "")]:
        by.setdefault(c, []).append((t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [r.conv_id for r in chat_format.query(chats(spark, [])).collect()] == [-1]
    against_sql(chat_format.query(df.where("turn IS NOT NULL AND conv_id IS NOT NULL")), chat_format.SQL, conversations=df.where("turn IS NOT NULL AND conv_id IS NOT NULL"))


def test_no_control_string_is_left_in_a_text(spark):
    out = chat_format.render(chat_format.fold(chat_format.events_of(chats(spark, ODD)))).collect()
    for r in out:
        assert "".join(p.text for p in r["mask"]) == r.formatted
        for p in r["mask"]:
            if p.loss:
                assert not any(c in p.text for c in chat_format.CONTROLS)


def test_events_are_folded(spark):
    log = [(1, 0, 1, "message", "user", "hello"), (1, 1, 2, "delta", "assistant", "wro"), (1, 1, 3, "delta", "assistant", "ng"), (1, 1, 4, "regenerate", "assistant", None), (1, 1, 5, "delta", "assistant", "ri"), (1, 1, 6, "delta", "assistant", "ght"), (1, 0, 7, "edit", "user", "hello!")]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    assert {(r.message, r.role, r.text) for r in chat_format.fold(df).collect()} == {(0, "user", "hello!"), (1, "assistant", "right")}


# packing and token files


def ids_of(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_best_fit_pack(spark, docs, no_docs):
    assert best_fit_pack.query(no_docs).count() == 0
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    got = {(r.doc_id, r.piece): r for r in best_fit_pack.query(docs).collect()}
    for r, ids in zip(rows, ids_of(best_fit_pack.default_tokenizer(), [r.text for r in rows])):
        ids = ids + [0]
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            p = got[r.doc_id, k]
            assert (p.start, p.length, p.ids_crc32) == (a, b - a, crc(ids[a:b]))
    placed = best_fit_pack.query(docs).toPandas().sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 2048


def test_packing_in_rounds_is_near_the_bound(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(1, 2049, 3000)
    df = spark.createDataFrame([(i, 0, 0, int(x), 0) for i, x in enumerate(n)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = best_fit_pack.pack(df, group=400).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == len(n) and got.groupby("sequence_id").length.sum().max() <= 2048
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    alone, _ = best_fit_pack.pack_lengths(n)
    assert got.sequence_id.nunique() <= 1.01 * (alone.max() + 1)


def test_packing_follows_sums_of_squares():
    """Each piece, longest first, goes where the sum of squared counts of open sequences by gap becomes smallest."""
    lengths = np.random.default_rng(5).integers(1, 101, 400)
    bins, place = best_fit_pack.pack_lengths(lengths, 100)
    gaps = {}
    for i in np.argsort(-lengths, kind="stable"):
        n, b = int(lengths[i]), int(bins[i])
        open_ = [g for g in gaps.values() if g >= n]

        def total(gap):
            after = list(gaps.values())
            after.remove(gap)
            after = [g for g in [*after, gap - n] if g]
            return sum(after.count(g) ** 2 for g in set(after))

        if open_:
            assert total(gaps[b]) == min(map(total, set(open_)))
        else:
            assert b not in gaps
        gap = gaps.get(b, 100)
        assert place[i] == 100 - gap
        gaps[b] = gap - n


def test_long_texts_are_encoded_in_parts(monkeypatch):
    from meridia.llm import _tokens

    text = " ".join(f"Wort{i} and, don't {i * 7}\n\n  été 日本 x" for i in range(700))
    monkeypatch.setattr(_tokens, "CHUNK", 1000)
    for path in (best_fit_pack.default_tokenizer(), token_binary.default_tokenizer()):
        made = _tokens.Encoder(path)
        for t in (text, text[:5003], "x" * 4000 + " y " * 900):
            assert np.frombuffer(made.encode(t), "<u4").tolist() == ids_of(path, [t])[0]


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, np.uint32)
    raw = token_binary.pack_bits(ids, width)
    assert len(raw) == 16 * width * 8 and (token_binary.unpack_bits(raw, 1000, width) == ids).all()


def test_token_files(spark, docs, no_docs, tmp_path, monkeypatch):
    assert token_binary.query(no_docs).count() == 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or ""))
    ids = [i + [2] for i in ids_of(token_binary.default_tokenizer(), [r.text for r in rows])]
    starts = np.cumsum([0] + [len(i) for i in ids])
    got = sorted(map(tuple, token_binary.query(docs).collect()), key=lambda r: r[1])
    assert got == [(r.doc_id, int(s), len(i), crc(i)) for r, i, s in zip(rows, ids, starts)]
    manifest = token_binary.write_files(docs, f"file://{tmp_path}/x", token_binary.default_tokenizer(), partitions=3)
    first = min(manifest.collect())
    store, at = token_binary.open_fs(first.path)
    reader = token_binary.Reader(store.open_input_file(at))
    every = np.concatenate(ids)
    assert (reader.ids(5, 300) == every[5:300]).all() and (reader.ids(0, reader.n) == every[: reader.n]).all()


# importance resampling


def test_importance_sample(spark, docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance_sample.resample(docs, labels).collect()
    assert len(got) == docs.count()
    texts = [r.text for r in docs.where("doc_id IS NOT NULL").collect()]
    assert sum(r.kept for r in got) >= int(0.8 * sum(1 for r in got if r.n_grams)) - 2
    assert all(r.log_weight is None and not r.kept for r in got if not r.n_grams) and texts
    assert importance_sample.resample(no_docs, labels).count() == 0
    assert {r.log_weight for r in importance_sample.resample(docs, labels.limit(0)).collect()} <= {0.0, None}
    # weights against a plain count
    from meridia.llm._shingles import WordHashes

    h, raw, good = WordHashes(), np.full(importance_sample.BUCKETS, 0.5), np.full(importance_sample.BUCKETS, 0.5)
    for r in docs.collect():
        c = np.bincount(importance_sample.grams(h.of(r.text)), minlength=importance_sample.BUCKETS)
        raw += c
        good += c * (r.doc_id in (5, 6))
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    want = {r.doc_id: float(ratio[importance_sample.grams(h.of(r.text))].mean() * importance_sample.SCALE) for r in docs.collect() if words(r.text)}
    assert all(abs(r.log_weight - want[r.doc_id]) < 1e-9 for r in got if r.n_grams)


def test_importance_keeps_the_top_by_noisy_weight(spark):
    """``kept`` against a plain top-k of log weight plus Gumbel noise."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = importance_sample.resample(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    noisy = {}
    for r in got:
        if r.log_weight is not None:
            u = max(int(hashlib.md5(f"gumbel:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52), 2.0**-60)
            noisy[r.doc_id] = r.log_weight - np.log(-np.log(u))
    top = set(sorted(noisy, key=noisy.get, reverse=True)[: int(len(noisy) * importance_sample.KEEP)])
    assert {r.doc_id for r in got if r.kept} == top and len(noisy) == len({r.doc_id for r in got if r.n_grams})


def test_license_ties_go_to_the_first_template(spark):
    df = spark.createDataFrame([(1, "Released under the Foo License."), (2, "released UNDER the foo license")], "doc_id long, text string")
    both = (("A", "Released under the Foo License."), ("B", "Released under the Foo License!"))
    assert {(r.license, r.template) for r in license_scan.scan(df, both).collect()} == {("A", 0)}
    assert {(r.license, r.template) for r in license_scan.scan(df, both[::-1]).collect()} == {("B", 0)}


def test_names_of_queries():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
