"""SentencePiece BPE encoding and decoding as whole-array merge rounds.

Symbols of many words lie in one flat array. A round looks up the rank of all neighbouring pairs, takes the least rank of
each word by a segmented minimum, merges its leftmost pair of that rank in all words at once, and closes the gaps; words
without a pair left are done. That is the order in which the library merges (best score first, the leftmost of equal ones).
Texts are cut before, where no piece of the vocabulary holds the two characters side by side: nothing is ever merged across such
a place. A piece of text that is still longer than ``LONG`` symbols (a run of one letter, say) merges by a heap of pairs in
the same order, as rounds would take the square of its length. Known words are remembered by worker, so a word is
merged once while it is remembered.

The model file is read through the sentencepiece package; neither encoding nor decoding calls it. Models of another kind than BPE
with byte fallback, the identity as normalisation and a leading blank are refused with an error.

Defined results: a null or empty text has no ids, and the empty string decoded; a character that is no piece becomes its UTF-8
bytes; U+2581 is read as a blank and comes back as one; names of control pieces in a text are ordinary text; rows that repeat an
id are judged each on its own; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._common import slices

BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: What an unknown id is decoded to.
UNKNOWN_TEXT = " ⁇ "
#: Symbols of a word that go through rounds; a longer one goes by a heap.
LONG = 1024
#: Words of a generation that a worker remembers; of two at most, what is not asked for again goes with the older.
REMEMBERED, SHORT = 400_000, 200
NONE = np.iinfo(np.int32).max
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def gather(ids: np.ndarray, blob: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    """The entries of ``blob`` that ids name, one after the other."""
    n = size[ids]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[ids] - ends + n, n)
    return blob[at].tobytes()


def laid_out(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size


class Pieces:
    """A model's pieces as tables: symbols are ids, and beyond them characters that only occur inside pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if trained.model_type != 2 or not trained.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"not a BPE model with byte fallback and plain blanks: {path}")
        names = [p.piece for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.n = len(names)
        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:-1], 16)] = i
        scores = -np.array([p.score for p in model.pieces])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, self.n + len(symbols) - len(normal))
        self.n_symbols = self.n + len(symbols) - len(normal)
        singles = sorted((ord(s), i) for s, i in symbols.items() if len(s) == 1)
        self.chars, self.char_ids = (np.array(x, np.int64) for x in zip(*singles))
        pairs = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.n_symbols + b] = i
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        by = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[by], np.fromiter(pairs.values(), np.int64, len(pairs))[by]
        self.pairs = pairs
        self.neighbours = np.unique([ord(a) << 21 | ord(b) for p in normal for a, b in zip(p, p[1:])])
        # words begin at blanks if no piece holds a blank behind another character
        self.words = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+") if not any((k & (1 << 21) - 1) == ord(BLANK) != k >> 21 for k in self.neighbours.tolist()) else re.compile(r"(?s).+")
        entries = [p.piece.replace(BLANK, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else UNKNOWN_TEXT.encode() if p.type == UNKNOWN else b"" for p in model.pieces]
        self.spelled = laid_out(entries)
        self.is_byte = np.isin(np.arange(self.n), self.bytes)
        self.blank_first = np.array([p.type == NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        self.is_control = np.array([p.type == CONTROL for p in model.pieces])
        self.decimal = laid_out([b"%d," % i for i in range(self.n)])

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each two symbols make; NONE where they make nothing. A negative symbol is no character known."""
        key = np.where((a < 0) | (b < 0), -1, a * self.n_symbols + b)
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
        hit = self.pair_keys[at] == key if len(self.pair_keys) else np.zeros(len(key), bool)
        made = np.where(hit, self.pair_made[at] if len(self.pair_keys) else 0, 0)
        return np.where(hit, self.rank[made], NONE), made


def merge_rounds(pieces: Pieces, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of all words; ``word`` numbers them, ascending. Returns the symbols left and their words."""
    rank, made = pieces.pair(symbol[:-1], symbol[1:])
    rank = np.append(np.where(word[:-1] == word[1:], rank, NONE), NONE)[: len(symbol)]
    made = np.append(made, 0)[: len(symbol)]
    done = []
    while len(symbol):
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, start)
        size = np.diff(np.append(start, len(symbol)))
        live = least < NONE
        if not live.all():
            keep = np.repeat(live, size)
            done.append((symbol[~keep], word[~keep]))
            symbol, word, rank, made, least, size = symbol[keep], word[keep], rank[keep], made[keep], least[live], size[live]
            if not len(symbol):
                break
        at = np.flatnonzero(rank == np.repeat(least, size))
        at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
        symbol[at] = made[at]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        rank[at] = NONE
        symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
        at -= np.arange(len(at))
        touched = np.zeros(len(symbol), bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        touched[-1] = False
        near = np.flatnonzero(touched)
        near_rank, near_made = pieces.pair(symbol[near], symbol[near + 1])
        rank[near] = np.where(word[near] == word[near + 1], near_rank, NONE)
        made[near] = near_made
        rank[-1] = NONE
    if not done:
        return symbol, word
    symbol, word = (np.concatenate(x) for x in zip(*done))
    by = np.argsort(word, kind="stable")
    return symbol[by], word[by]


def merge_by_heap(pieces: Pieces, symbol: list[int]) -> list[int]:
    """One long word: the same merges in the same order, n log n."""
    n, m = len(symbol), pieces.n_symbols
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    pairs, rank, heap = pieces.pairs, pieces.rank, []

    def offer(i: int, j: int) -> None:
        a, b = symbol[i], symbol[j]
        if a >= 0 and b >= 0 and (made := pairs.get(a * m + b)) is not None:
            heapq.heappush(heap, (int(rank[made]), i, j, a, b, made))

    for i in range(n - 1):
        offer(i, i + 1)
    gone = bytearray(n)
    while heap:
        _, i, j, a, b, made = heapq.heappop(heap)
        if gone[i] or gone[j] or right[i] != j or symbol[i] != a or symbol[j] != b:
            continue
        symbol[i], gone[j] = made, 1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            offer(i, right[i])
        if left[i] >= 0:
            offer(left[i], i)
    return [s for s, g in zip(symbol, gone) if not g]


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian numbers of 32 bits; nothing merges from one to the next."""
        p = self.pieces
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(code):
            return [b""] * len(words)
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.minimum(np.searchsorted(p.chars, code), len(p.chars) - 1)
        symbol = np.where(p.chars[at] == code, p.char_ids[at], -1 - code)
        key = code[:-1] << 21 | code[1:]
        near = np.minimum(np.searchsorted(p.neighbours, key), len(p.neighbours) - 1)
        cut = np.append(True, (owner[1:] != owner[:-1]) | (p.neighbours[near] != key))
        part = np.cumsum(cut) - 1
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(code)))
        short = np.repeat(size <= LONG, size)
        out_symbol, out_part = merge_rounds(p, symbol[short], part[short])
        if not short.all():
            extra = [(np.array(merge_by_heap(p, symbol[start[k] : start[k] + size[k]].tolist())), k) for k in np.flatnonzero(size > LONG).tolist()]
            out_symbol = np.concatenate([out_symbol, *(s for s, _ in extra)])
            out_part = np.concatenate([out_part, *(np.full(len(s), k) for s, k in extra)])
            by = np.argsort(out_part, kind="stable")
            out_symbol, out_part = out_symbol[by], out_part[by]
        out_owner = owner[start][out_part]
        odd = np.flatnonzero((out_symbol < 0) | (out_symbol >= p.n))
        if len(odd):  # characters that are no piece: their bytes
            inner = {int(i): int(c) for c, i in zip(p.chars, p.char_ids) if i >= p.n}
            raw = [chr(-1 - s if s < 0 else inner[s]).encode() for s in out_symbol[odd].tolist()]
            times = np.ones(len(out_symbol), np.int64)
            times[odd] = [len(r) for r in raw]
            out_symbol, out_owner = np.repeat(out_symbol, times), np.repeat(out_owner, times)
            where = np.repeat(np.cumsum(times)[odd] - times[odd], times[odd])
            inside = np.concatenate([np.arange(len(r)) for r in raw])
            out_symbol[where + inside] = p.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        raw, ends = out_symbol.astype("<u4").tobytes(), (4 * np.searchsorted(out_owner, np.arange(len(words)), "right")).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.pieces.words.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        asked = set().union(*cut)
        fresh = asked.difference(self.known)
        old = [w for w in fresh if w in self.older]
        self.known.update(zip(old, map(self.older.__getitem__, old)))
        fresh = sorted(fresh.difference(old), key=len)  # rounds end together where lengths are alike
        self.known.update(zip(fresh, self.encode_words(fresh)))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4").astype(np.int64) for words in cut]
        for w in reversed(fresh):
            if len(w) <= SHORT:
                break
            del self.known[w]
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with blanks for U+2581, the first piece without one leading blank, bytes read as UTF-8 (what
        is no UTF-8 becomes U+FFFD, a byte each)."""
        p = self.pieces
        ids = np.asarray(ids, np.int64)
        control = np.flatnonzero(p.is_control[ids])
        if len(control):  # bytes on both sides of a control piece make no character
            parts = [part[part_control:] for part, part_control in zip(np.split(ids, control), [0] + [1] * len(control))]
            first = next((k for k, part in enumerate(parts) if len(part)), 0)
            return "".join(self._spell(part, k == first) for k, part in enumerate(parts))
        return self._spell(ids, True)

    def _spell(self, ids: np.ndarray, first: bool) -> str:
        raw = gather(ids, *self.pieces.spelled)
        if first and len(ids) and self.pieces.blank_first[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in raw.decode("utf-8", "surrogateescape"))

    def decimals(self, ids: np.ndarray) -> bytes:
        return gather(ids, *self.pieces.decimal)[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a Python worker, kept from task to task."""
    return Codec(path)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every document."""
    return _mapped(docs, model or default_model(), "doc_id long, ids array<int>, decoded string", lambda known, ids: (ids.tolist(), known.decode(ids)))


def query(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Digests of every document's ids and decoded text."""
    return _mapped(docs, model or default_model(), SCHEMA, lambda known, ids: (len(ids), hashlib.sha256(known.decimals(ids)).hexdigest(), hashlib.sha256(known.decode(ids).encode()).hexdigest()))


def _mapped(docs: DataFrame, model: str, schema: str, row) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [pa.field(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            known = codec(model)
            rows = [row(known, ids) for ids in known.encode(part.column("text").to_pylist())]
            columns = [part.column("doc_id").to_pylist(), *zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
