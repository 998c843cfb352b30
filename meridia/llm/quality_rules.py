"""Quality rules as a short-circuit cascade.

Each rule rejects a text. On a sample every rule is run on every text; its cost (seconds a text) and its
rejection rate order the rules by rejections per second, so that most bad texts leave at the first, cheap rules
and later rules run only on what is left. The verdict does not depend on the order: a text is kept if no rule
rejects it.

Defined results: a null or empty text has no words, so ``too_few_words`` rejects it; null ids and repeated rows
are judged like any other row; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._common import slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Texts that order the rules; the order changes what is run, never what is kept.
SAMPLE_TEXTS = 2000


class Text:
    """A text and what rules ask of it, each computed once and only if asked."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words, WINDOW)

    @cached_property
    def letters(self) -> tuple[int, int]:
        """Letters, and those in upper case."""
        raw = np.frombuffer(self.text.encode("utf-8", "surrogatepass"), np.uint8)
        high = int((raw >= 0xC0).sum())  # each starts a character outside ASCII, taken as a lower-case letter
        upper = int(((raw >= 65) & (raw <= 90)).sum())
        return upper + high + int(((raw >= 97) & (raw <= 122)).sum()), upper


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur twice or more in the text.

    Windows get exact ranks by doubling: the rank of 2k words is that of the pair of ranks of k words.
    """
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    width, distinct = 1, len(ids)
    while width < window:
        _, rank, times = np.unique(rank[:-width] * distinct + rank[width:], return_inverse=True, return_counts=True)
        width, distinct = 2 * width, len(times)
        if distinct == len(rank):
            return 0
    begins = np.flatnonzero(times[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def base_failed(t: Text) -> bool:
    return t.n_words < MIN_WORDS or 100 * t.n_repeat_words > 30 * t.n_words


BASE_RULES = (
    Rule("too_few_words", lambda t: t.n_words < MIN_WORDS),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
#: Thresholds are percentages of words, lines or letters; ordinary prose stays far below each of them.
STYLE_RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 25 * t.n_words),
    Rule("duplicate_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("upper_case", lambda t: 100 * t.letters[1] > 30 * t.letters[0]),
    Rule("exclamations", lambda t: 100 * t.text.count("!") > 50 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
)


@dataclass(frozen=True)
class Estimate:
    rule: str
    texts: int
    seconds: float
    rejected: int

    @property
    def gain(self) -> float:
        """Rejections per second of the rule's cost."""
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, rules: tuple[Rule, ...], sample_texts: int = SAMPLE_TEXTS, seed: int = 7) -> list[Estimate]:
    """Cost and selectivity of each rule over about ``sample_texts`` texts drawn from all of docs; best rule first."""
    share = min(1.0, sample_texts / max(1, docs.count()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {r.name: [0, 0.0, 0] for r in rules}
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                for r in rules:
                    fresh, began = Text(text), time.perf_counter()
                    bad = r.rejects(fresh)
                    row = total[r.name]
                    row[0], row[1], row[2] = row[0] + 1, row[1] + time.perf_counter() - began, row[2] + bad
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), *(pa.array([v[i] for v in total.values()], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64())))], ["rule", "texts", "seconds", "rejected"])

    sample = docs.select("text").sample(fraction=share, seed=seed)
    rows = sample.mapInArrow(measure, "rule string, texts long, seconds double, rejected long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("texts", "seconds", "rejected"))).collect()
    return sorted((Estimate(r.rule, r.texts, r.seconds, r.rejected) for r in rows), key=lambda e: (-e.gain, e.seconds))


def ordered(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    place = {e.rule: i for i, e in enumerate(estimates)}
    return tuple(sorted(rules, key=lambda r: place.get(r.name, len(place))))


def passes(text: Text, rules: tuple[Rule, ...]) -> bool:
    return not any(r.rejects(text) for r in rules)


def score(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, the base statistics of the whole text, base_failed, and kept: the cascade of STYLE_RULES on the rest."""
    rules = ordered(STYLE_RULES, estimate(docs, STYLE_RULES, sample_texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns: list[list] = [[] for _ in range(len(names) + 2)]
            for text in part.column("text").to_pylist():
                t = Text(text)
                for column, name in zip(columns, names):
                    column.append(getattr(t, name))
                failed = base_failed(t)
                columns[-2].append(failed)
                columns[-1].append(not failed and passes(t, rules))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:-2]), *(pa.array(c, pa.bool_()) for c in columns[-2:])], ["doc_id", *names, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean")


def keep(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """The rows of docs, all columns, that no base or style rule rejects; rules run in the cascade's order."""
    every = BASE_RULES + STYLE_RULES
    rules = ordered(every, estimate(docs, every, sample_texts))

    @F.pandas_udf("boolean")
    def good(texts):
        return texts.map(lambda x: passes(Text(x), rules)).astype(bool)

    return docs.where(good("text"))


def _sql() -> str:
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    symbols = r"len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words} AS w, {symbols} AS n_symbols FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d WHERE len(w) >= 8)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(0, 8) r(j) GROUP BY doc_id),
    ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                 n_symbols::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
                 length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_letters,
                 length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters, length(regexp_replace(text, '[^!]', '', 'g')) AS marks
          FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * upper_letters > 30 * letters
             OR 100 * marks > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
    FROM b"""


SQL = _sql()
