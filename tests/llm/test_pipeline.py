"""The pipeline's stages against plain versions of their decisions."""

from collections import Counter

import duckdb

import corpus_pipeline
from meridia.llm import best_fit_pack, language_id, quality_rules, source_mix
from tests.llm.test_operators import crc, ids_of, plain_components, plain_sets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard", "source_mix", "best_fit_pack"]
    seen, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF).cache()
        before, after = {r.doc_id: r.text for r in seen.collect()}, [r.doc_id for r in out.collect()]
        if name == "language_id":
            assert set(after) == {r.doc_id for r in language_id.query(seen).where(f"lang_pred <> 'und' AND score >= {language_id.LEAST_SCORE}").collect()}
        elif name == "quality_rules":
            assert set(after) == {r.doc_id for r in quality_rules.score(seen).where("kept").collect()}
        elif name == "ngram_jaccard":
            ids = sorted(before)
            assert sorted(after) == [i for i, c in plain_components(ids, plain_sets([before[i] for i in ids])).items() if i == c]
        elif name == "source_mix":
            c = duckdb.connect()
            c.register("documents", seen.toArrow())
            taken = {i: t // n for i, n, t in c.sql(f"SELECT doc_id, size, taken FROM ({source_mix.SQL}) WHERE size > 0").fetchall()}
            assert Counter(after) == {i: n for i, n in taken.items() if n} and max(taken.values()) <= 2
        elif name == "best_fit_pack":
            packed = sorted((r.sequence_id, r.offset, r.length, r.doc_id, r.piece, r.ids_crc32) for r in out.collect())
            texts = [(r.doc_id, r.text) for r in seen.collect()]
            want = Counter()
            for (i, _), ids in zip(texts, ids_of(best_fit_pack.default_tokenizer(), [t for _, t in texts])):
                ids = ids + [0]
                edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
                want.update((i, k, crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])))
            assert Counter((d, k, x) for *_, d, k, x in packed) == want
            for (s, o, n, *_), (s2, o2, *_) in zip(packed, packed[1:]):
                assert o2 == (o + n if s == s2 else 0) and o + n <= 2048
        if name != "best_fit_pack":
            assert out.columns == columns
            seen = out
    assert set(after) == {r.doc_id for r in seen.collect()}
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_odd_documents(spark, docs):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing names: every stage runs and returns the columns."""
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF).cache()
        if name != "best_fit_pack":
            assert out.columns == docs.columns and out.count() <= 2 * seen.count()
            seen = out
    assert seen.count() > 0 and out.count() >= seen.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
