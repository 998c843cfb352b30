"""Prefix trie, SentencePiece codec and periodic runs: against SQL, the library and brute force, on odd rows and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from meridia.llm import periodic_runs, piece_codec, prefix_trie, queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth string, n string, block string, key string"


# conversations


def nodes(df):
    return sorted(map(repr, map(tuple, df.select(*prefix_trie.COLUMNS, "ends_sha256").collect())))


def nodes_by_sql(df):
    c = duckdb.connect()
    c.register("conversations", df.toArrow())
    return sorted(map(repr, c.sql(f"SELECT {', '.join(prefix_trie.COLUMNS)}, ends_sha256 FROM ({prefix_trie.SQL})").fetchall()))


@pytest.fixture(scope="module")
def talks(spark):
    """Null and repeated turns, ties, null ids, texts without words, one first turn that a third share, a long conversation and its copy."""
    rnd = random.Random(5)
    rows = [(None, 0, "user", "nobody's"), (1, None, "user", "first"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, ""), (2, 7, "user", ""), (-3, 1, "a", "b c"), (-3, 0, "ab", " c")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["yes", "no", "maybe so", " \n", "x " * 9])) for c in range(40, 160) for t in range(rnd.randrange(0, 7))]
    rows += [(c, 0, "system", "the same for all") for c in range(200, 260)]
    rows += [(c, t, "user", f"turn {t % 11}") for c in (300, 303, 306, 317) for t in range(400)]
    return spark.createDataFrame([r + ("x",) * 4 for r in rows], TURNS).cache()


def test_trie_is_that_of_sql(spark, talks):
    want = nodes_by_sql(talks)
    assert nodes(prefix_trie.query(talks)) == want


@pytest.mark.parametrize("block_turns", [1, 7, 300])
def test_trie_across_blocks(spark, talks, block_turns):
    """Nodes that go through many blocks, the root among them, are added up."""
    few = talks.where("conv_id < 270")
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.symbols(few)), block_turns)) == nodes_by_sql(few)


def test_trie_of_nothing(spark, talks):
    assert prefix_trie.query(talks.where("false")).count() == 0
    assert prefix_trie.query(talks.where("conv_id IS NULL")).count() == 0


def test_ids_of_a_large_class_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    df = spark.range(0, 1000).selectExpr("id * 3 AS conv_id", "0L AS turn", "'user' AS role", "'hello there' AS text")
    got = {r.depth: r for r in prefix_trie.trie(prefix_trie.symbols(df)).collect()}
    ends = hashlib.sha256(",".join(str(3 * i) for i in range(1000)).encode()).hexdigest()
    assert got[1].ends_sha256 == ends and got[1].n_convs == 1000 and got[1].saved_tokens == 999 * 2 and got[0].ends_sha256 == prefix_trie.NOBODY


def test_extents_are_those_of_a_plain_scan():
    rng = np.random.default_rng(2)
    strings = sorted({bytes(np.repeat(rng.integers(0, 2, rng.integers(0, 9)).astype(np.uint8), prefix_trie.SYMBOL)) for _ in range(90)})
    block = prefix_trie.Block(strings, np.ones(len(strings), np.int64), rng.integers(0, 99, len(strings)), -1, -1)
    for i, s in enumerate(strings):
        for d in range(len(s) // prefix_trie.SYMBOL + 1):
            members = [k for k, t in enumerate(strings) if t.startswith(s[: d * prefix_trie.SYMBOL]) and len(t) >= d * prefix_trie.SYMBOL]
            a, b = np.array([i]), np.array([d])
            assert (block.left(a, b)[0], block.right(a, b)[0]) == (members[0], members[-1])
            assert block.smallest_id(block.left(a, b), block.right(a, b))[0] == block.least[members].min()


# pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


def odd_texts(library):
    rnd = random.Random(3)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    fixed = ["", " ", "a  b", "▁x", "a\x00b", "\n\n\t", "<s>x</s>", "<unk> <0x41>", "  hi  ", "é", "ﬁ", "日本語", "　 x", "😀" * 9, " " * 100, " " * 3000 + "x", "a" * 3000, "ab" * 900, "=-" * 900 + "=" * 1500]
    made = ["".join(rnd.choice(rnd.choice([pieces, "abcdefgh  etaoin", "  ▁\n", "aab"])) for _ in range(rnd.randint(1, 60))) for _ in range(800)]
    return fixed + made + ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2500))]


def test_pieces_are_those_of_the_library(library):
    texts = odd_texts(library)
    known = piece_codec.Codec(piece_codec.default_model())
    for text, ids in zip(texts, known.encode(texts)):
        want = library.encode(text)
        assert ids.tolist() == want
        assert known.decode(ids) == library.decode(want)
        assert known.decimals(ids).decode() == ",".join(map(str, want))


def test_words_are_forgotten_in_generations(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 50)
    monkeypatch.setattr(piece_codec, "SHORT", 5)
    known = piece_codec.Codec(piece_codec.default_model())
    texts = odd_texts(library)[:300]
    for k in range(0, 300, 20):
        assert [x.tolist() for x in known.encode(texts[k : k + 20])] == library.encode(texts[k : k + 20])
        assert len(known.known) < 50


def test_any_ids_are_decoded(library):
    rnd = random.Random(4)
    known = piece_codec.Codec(piece_codec.default_model())
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), 3 + rnd.randrange(256), 3 + rnd.choice(list("é日😀".encode())), 1, 2, 0, 259]) for _ in range(rnd.randint(0, 8))]
        if 0 not in ids[:1]:
            assert known.decode(np.array(ids, int)) == library.decode(ids), ids


def test_codec_refuses_other_models(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(piece_codec.default_model(), "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_codec.Pieces(str(path))


def test_piece_query(spark, docs, no_docs, library):
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted(map(repr, map(tuple, piece_codec.query(df).collect())))
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert got == sorted(map(repr, want))
    assert piece_codec.query(no_docs).count() == 0
    row = piece_codec.encode(docs.where("doc_id = 16")).first()
    assert row.ids == library.encode("日本語のテキスト") and row.decoded == "日本語のテキスト"


# runs


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], (w[:-q] == w[q:]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            n = b - a + q
            if n >= max(6, 4 * q) and not any(s <= a and s + m >= a + n for s, m, _ in out):
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    texts = []
    for t in range(400):
        w = rng.integers(1, rng.integers(2, 6), rng.integers(0, 120))
        if t % 2:
            p = int(rng.integers(1, 12))
            w = np.concatenate([w, np.tile(rng.integers(1, 4, p), rng.integers(1, 9))[rng.integers(0, p) :], rng.integers(1, 4, rng.integers(0, 20))])
        texts.append(w)
    for w, found in zip(texts, periodic_runs.detect([[str(x) for x in w] for w in texts])):
        assert [tuple(r) for r in found.tolist()] == plain_runs(w)


def test_common_extensions():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40):
        w = rng.integers(1, 3, n)
        tree = periodic_runs.SuffixTree(w.tolist())
        for i in range(n):
            for j in range(n + 1):
                if i != j:
                    k = 0
                    while max(i, j) + k < n and w[i + k] == w[j + k]:
                        k += 1
                    assert tree.extension(np.array([i]), np.array([j]))[0] == k
        assert sorted(range(n + 1), key=lambda i: w[i:].tolist()) == tree.order.tolist()


def plain_row(doc_id, text):
    w = re.findall(r"[^ \t-\r]+", text or "")
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(np.array(w, object)) if w else []
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed, left = "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_run_query(spark, docs, no_docs):
    more = spark.createDataFrame([(100 + k, " ".join("ab a ab a c".split()[i % (2 + k % 3)] for i in range(k)) + " x " * (k % 9)) for k in range(60)], "doc_id long, text string")
    for df in (docs, more, spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 6000")):
        got = sorted(map(repr, map(tuple, periodic_runs.query(df).collect())))
        assert got == sorted(repr(plain_row(r.doc_id, r.text)) for r in df.select("doc_id", "text").collect())
    assert periodic_runs.query(no_docs).count() == 0


def test_long_period_and_long_run(spark):
    """A run of one word and one of a long period, in texts of 50,000 words."""
    for p in (1, 12_000):
        w = [f"w{i % p}" for i in range(50_000)]
        assert [tuple(r) for r in periodic_runs.detect([w])[0].tolist()] == [(0, 50_000, p)]


def test_queries_are_registered():
    assert {"op11_prefix_trie", "op12_piece_codec", "op13_periodic_runs"} <= queries.QUERIES.keys()
    assert "op11_prefix_trie" in queries.ORACLE
