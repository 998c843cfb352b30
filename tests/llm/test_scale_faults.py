"""What only shows at size: large counts, many rounds, clashing fingerprints, extreme vectors, cells that are not visited."""

import numpy as np
from pyspark.sql import functions as F

from meridia.llm import _shingles, best_fit_pack, embedding_dedup, language_id, ngram_jaccard


def test_language_draw_of_a_huge_label(spark):
    """Ten billion texts of a label: the product of count and draw has no bound, the share drawn is right."""
    df = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    assert df.where(language_id.drawn_at(F.col("h"), F.lit(9_000_000_000), 600)).count() == 0
    assert df.where(language_id.drawn_at(F.col("h"), F.lit(10), 600)).count() == 200_000
    share = df.where(language_id.drawn_at(F.col("h"), F.lit(200_000), 600)).count()
    assert 1000 < share < 1450


def test_sequences_of_many_rounds_have_numbers_of_their_own(spark):
    rng = np.random.default_rng(0)
    lengths = rng.integers(300, 1500, 3000).tolist() + [2048] * 5
    df = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = best_fit_pack.pack(df, group=6, loose=0.0).toPandas()
    assert len(got) == len(lengths) and got.groupby("sequence_id")["length"].sum().max() <= 2048
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].to_numpy() == np.concatenate([[0], own["length"].cumsum()[:-1]])).all()


def test_classes_whose_fingerprints_clash_are_told_apart(spark, monkeypatch):
    """First halves of fingerprints that many different sets have in common change nothing."""
    real = _shingles.fingerprint

    def clashing(shingles):
        one, two = real(shingles)
        return one % 5, two

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(k, text(k)) for k in range(30)] + [(100 + k, text(k) + " more") for k in range(10)] + [(200 + k, text(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, ngram_jaccard.components(df).collect()))
    monkeypatch.setattr(ngram_jaccard, "fingerprint", clashing)
    assert sorted(map(tuple, ngram_jaccard.components(df).collect())) == want
    assert {r.doc_id for r in ngram_jaccard.keep(df).collect()} == set(range(30))
    assert {c for _, _, c in want} == set(range(30))


def test_vectors_of_extreme_length(spark):
    rows = [(1, [1e-200, 1e-201], 0), (2, [0.5, 1.0], 0), (3, [1e200, 1e200], 1), (4, [2e200, 2e200], 1), (5, [1e-300, 1e-300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3)}


def test_recall_where_cells_are_not_visited(spark):
    """A third of the rows in one dense group, the others with a partner each, far more cells than visits."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    dense = unit(unit(rng.standard_normal((1, 64))) + unit(rng.standard_normal((1000, 64))) * np.sqrt(1 / 0.95 - 1))
    x = unit(rng.standard_normal((1000, 64)))
    aside = rng.standard_normal((1000, 64))
    aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
    v = np.concatenate([dense, x, 0.935 * x + np.sqrt(1 - 0.935**2) * aside])
    c = embedding_dedup.spherical_kmeans(v[rng.permutation(len(v))[:2000]], 150)
    home, visits = embedding_dedup.reached(v, c, False)
    everything = embedding_dedup.reached(v, c, True)[1]
    link = np.triu(v @ v.T >= 0.93, 1)
    met = (home[:, None] == home) | visits[:, home] | visits[:, home].T
    pairs = link[1000:, 1000:]
    assert (met & link).sum() >= 0.97 * link.sum() and (met[1000:, 1000:] & pairs).sum() >= 0.97 * pairs.sum() and pairs.sum() >= 1000
    assert visits[1000:].sum() < 0.3 * everything[1000:].sum()
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df, cell_rows=20, exact=False).agg(F.sum("n_links")).first()[0]
    assert 0.97 * 2 * link.sum() <= got <= 2 * link.sum()
