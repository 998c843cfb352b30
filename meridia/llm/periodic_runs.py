"""Runs of repeated words: maximal periodic stretches, found by longest common extensions in suffix trees.

Of each stretch of words that can hold a run, and of its reversal, Ukkonen's algorithm builds the suffix tree; an Euler tour
keeps, between two leaves, the depth of the lowest node passed, and a sparse table over it answers the common extension of two
places in constant time. Every run contains a Lyndon root of one of the two alphabet orders, so the longest Lyndon words
that begin at each place are the candidates (place, period); each is extended to the left and to the right.

A run of period q has 4q words at least (and six): each word occurs four times in it, each triple three times. What lies
between rarer ones is cut away before trees are built: counts by hash can only leave too much in, never cut a run.
Trees take about 300 bytes a word of the stretch that is looked at, in one task; documents are independent, nothing is shuffled.

Defined results: a null or empty text has no words, no run, and the digest of the empty string twice; a null id has no
rewriting (``rewrite``); rows that repeat an id are judged each on its own; an empty table gives an empty result; other
columns are never looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._common import WORD_PATTERN, slices

WORDS = re.compile(WORD_PATTERN)
#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Counters of word triples; an Arrow slice holds fewer words than this.
COUNTERS = 1 << 22
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class SuffixTree:
    """The suffix tree of ``word`` (numbers from 1) closed by 0, as the order of its leaves and the depths between them."""

    def __init__(self, word: list[int]):
        self.text = [*word, 0]
        self.width = max(self.text) + 1
        self._build()
        pre = self._tour(False)
        leaf = self.suffix[pre] >= 0
        self.order = self.suffix[pre[leaf]]
        # what is passed before a leaf since the last one: the parent of the only node on the way that is no first child
        turn = self.turn[pre]
        passed = np.maximum.accumulate(np.where(turn >= 0, np.arange(len(pre)), 0))
        n = len(self.text)
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        self.table = [np.maximum(turn[passed[leaf]], 0).astype(np.int32)]
        while 2 ** len(self.table) <= n:
            low, half = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    def _build(self) -> None:
        """Ukkonen: one phase a symbol; (node, edge, length) is where the longest suffix that is still implicit ends. Leaves
        are made in the order of their suffixes, and a node made for suffix j in phase i is i - j symbols deep."""
        text, width, n = self.text, self.width, len(self.text)
        begin, end, child, depth, suffix, link = [0], [0], {}, [0], [-1], [0]
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            fresh = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    depth.append(0)
                    suffix.append(i - waiting + 1)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    at = begin[below]
                    span = end[below] - at
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[at + length] == symbol:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    middle = len(begin)
                    child[key] = middle
                    begin += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    depth += (waiting - 1, 0)
                    suffix += (-1, i - waiting + 1)
                    begin[below] = at + length
                    child[middle * width + text[at + length]] = below
                    child[middle * width + symbol] = middle + 1
                    if fresh:
                        link[fresh] = middle
                    fresh = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.suffix, self.depth = np.array(suffix), np.array(depth)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self.parents, self.symbols = np.divmod(keys, width)
        self.children = np.fromiter(child.values(), np.int64, len(child))

    def _tour(self, backwards: bool) -> np.ndarray:
        """All nodes, each before its children; ``backwards``: larger symbols first, but the end of the text comes first either
        way. ``turn`` becomes the parent's depth of all nodes that are no first child, else -1."""
        symbols = np.where(self.symbols > 0, self.width - self.symbols, 0) if backwards else self.symbols
        by = np.lexsort((symbols, self.parents))
        parents, children = self.parents[by], self.children[by]
        self.turn = np.full(len(self.suffix), -1)
        later = np.flatnonzero(parents[1:] == parents[:-1]) + 1
        self.turn[children[later]] = self.depth[parents[later]]
        ends = np.searchsorted(-parents[::-1], -np.arange(len(self.suffix) + 1), "right")
        laid, last, first = children[::-1].tolist(), ends.tolist(), np.append(ends[1:], 0).tolist()
        pre, stack = [], [0]
        while stack:
            node = stack.pop()
            pre.append(node)
            stack += laid[first[node] : last[node]]
        return np.array(pre)

    def ranks_backwards(self) -> np.ndarray:
        pre = self._tour(True)
        rank = np.empty(len(self.text), np.int64)
        rank[self.suffix[pre[self.suffix[pre] >= 0]]] = np.arange(len(self.text))
        return rank

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from a and from b on (a != b), by the lowest common ancestor of the two leaves."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at, t = level == k, self.table[k]
            out[at] = np.minimum(t[low[at]], t[high[at] - 2**k + 1])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word from each place on: up to the next smaller suffix. The last suffix is the end."""
    r = rank.tolist()
    out, smaller = [0] * (len(r) - 1), [len(r) - 1]
    for i in range(len(r) - 2, -1, -1):
        own = r[i]
        while r[smaller[-1]] > own:
            smaller.pop()
        out[i] = smaller[-1] - i
        smaller.append(i)
    return np.array(out)


def runs_of(word: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of a word of numbers from 1, by start, then period."""
    n = len(word)
    symbols = np.unique(word, return_inverse=True)[1] + 1
    tree, back = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    period = np.concatenate([lyndon_lengths(tree.rank), lyndon_lengths(tree.ranks_backwards())])
    at = np.tile(np.arange(n), 2)
    keep = period * LEAST_PERIODS <= n
    at, period = at[keep], period[keep]
    right = tree.extension(at, at + period)
    left = back.extension(n - at, n - at - period)
    length = left + period + right
    keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    found = np.stack([at - left, length, period], 1)[keep]
    return np.unique(found, axis=0)[:, [0, 1, 2]] if len(found) else found


def stretches(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what can hold runs: stretches of a group in which all words occur four times or more in the group and
    all triples three times or more."""
    n = len(ids)
    if n < LEAST_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w, g = ids.astype(np.uint64), group.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] * np.uint64(0x165667B19E3779F9) + g[:-2] * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        single = (w * np.uint64(0x9E3779B97F4A7C15) + g * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    cell, own = (mixed >> np.uint64(42)).astype(np.int32), (single >> np.uint64(42)).astype(np.int32)
    four = np.bincount(own, minlength=COUNTERS)[own] >= LEAST_PERIODS
    often = (np.bincount(cell, minlength=COUNTERS)[cell] >= LEAST_PERIODS - 1) & (group[:-2] == group[2:]) & four[:-2] & four[1:-1] & four[2:]
    # a stretch must not pass from one group to the next: two triples side by side belong to one group
    edge = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2] + 2
    keep = end - begin >= LEAST_WORDS
    return begin[keep], end[keep]


def found_in(ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(offset, runs) of the stretches that hold runs; ``ids`` are the words of several documents, one after the other."""
    begin, end = stretches(ids, doc)
    while len(begin):  # rarer triples inside a stretch cut it further
        inside = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
        number = np.repeat(np.arange(len(begin)), end - begin)
        a, b = stretches(ids[inside], number)
        held = len(inside)
        begin, end = inside[a], inside[b - 1] + 1
        if (end - begin).sum() > 0.9 * held:
            break
    out = []
    for a, b in zip(begin.tolist(), end.tolist()):
        found = runs_of(ids[a:b])
        if len(found):
            out.append((a, found))
    return out


def rewrite(words: list[str], doc_id: int | None) -> list[str]:
    """The words of a document; for a tenth of the ids, those from a place on repeat their beginning."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def collapse(words: list[str], runs: np.ndarray) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def detect(texts: list[list[str]]) -> list[np.ndarray]:
    """The runs of each list of words."""
    numbers = defaultdict(count(1).__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    held: dict[int, list[np.ndarray]] = defaultdict(list)
    for at, runs in found_in(ids, np.repeat(np.arange(len(texts)), sizes)):
        k = int(np.searchsorted(ends, at, "right"))
        held[k].append(runs + [at - (ends[k] - sizes[k]), 0, 0])
    none = np.empty((0, 3), np.int64)
    out = []
    for k in range(len(texts)):
        runs = np.concatenate(held[k]) if k in held else none
        out.append(runs[np.lexsort((runs[:, 2], runs[:, 0]))])
    return out


def _row(doc_id: int | None, words: list[str], runs: np.ndarray) -> tuple:
    best = (None, None, None, None)
    if len(runs):
        start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(collapse(words, runs)).encode()).hexdigest())


def find_runs(docs: DataFrame, prepare=None) -> DataFrame:
    """A row a document: its runs' number, the longest, digests of all runs and of the collapsed text. ``prepare(words,
    doc_id)`` may change the words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int64()] * 6 + [pa.string()] * 2
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            texts = [WORDS.findall(t or "") for t in part.column("text").to_pylist()]
            if prepare is not None:
                texts = [prepare(t, i) for t, i in zip(texts, ids)]
            rows = [_row(i, t, r) for i, t, r in zip(ids, texts, detect(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return find_runs(docs, rewrite)
