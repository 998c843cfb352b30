"""Language identification by hierarchical discrimination.

Texts become hashed counts of letter 1- to 3-grams (blanks mark word ends), on the Hellinger scale (square root of
relative frequency). A linear model per language family decides the family; within it, one-versus-one linear support
vector machines vote for the language. All models are fitted here on a bounded sample of labelled texts.

The sample is drawn from the distinct texts of each language by a hash of the text, so reruns fit equal machines.
Features and weights are rounded to integers whose products a double holds exactly: a prediction does not depend on
which texts are multiplied together.

Defined results: a null text, or one without letters, is ``und`` with score 0; the labels, source and id of a row
never enter its prediction; with no labelled text at all every row is ``und``; repeated rows get equal results; every
label is learned, however rare (the machines grow with the number of labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._common import checked_broadcast, slices, stage_table

#: ISO 639-1 codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "sinitic": ("zh", "yue"),
}
UNKNOWN = "und"
BITS = 13
ORDERS = (1, 2, 3)
#: Bound of the training sample: texts of one language, and of all languages together (but one a language at least).
TEXTS_PER_LANGUAGE, TEXTS_IN_ALL = 600, 4000
#: The pipeline keeps documents whose language is predicted with this score at least.
LEAST_SCORE = 0.5
#: Texts multiplied at a time; units of a feature and of a weight.
BLOCK, UNIT, WEIGHT_UNIT = 256, 1 << 12, 1 << 16
CHUNK = 1_000_000
_MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only {lang}")


class Features:
    """Hashed n-gram counts of a text; one object per Python worker."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)

    def _codes(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(self.letter[np.minimum(code, 0x10FFFF)], code, np.uint32(32))

    def counts(self, text: str | None) -> np.ndarray | None:
        """None if there is no letter. Long texts go chunk by chunk with an overlap, so memory stays bounded."""
        total, any_letter = np.zeros(1 << BITS, np.int64), False
        text = f" {text or ''} "
        for at in range(0, len(text), CHUNK):
            code = self._codes(text[max(0, at - max(ORDERS) + 1) : at + CHUNK])
            blank = code == 32
            any_letter = any_letter or not blank.all()
            for n in ORDERS:
                lead = (min(at, max(ORDERS) - 1) - (n - 1)) if at else 0  # grams that end in this chunk
                if len(code) - lead < n:
                    continue
                h = np.zeros(len(code) - n + 1, np.uint32)
                for k in range(n):
                    h = (h + code[k : len(code) - n + 1 + k]) * _MIX[k]
                    h ^= h >> np.uint32(15)
                good = ~blank[: len(h)] | ~blank[n - 1 :]
                if n == 3:
                    good &= ~blank[1:-1]  # no gram spans two words
                elif n == 1:
                    good = ~blank
                h, good = h[lead:], good[lead:]
                total += np.bincount((h[good] * np.uint32(2246822519) + np.uint32(n)) >> np.uint32(32 - BITS), minlength=1 << BITS)
        return total if any_letter else None


def _unit(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 15, seed: int = 3) -> np.ndarray:
    """Weights (the last one is the bias) of an L2-regularised hinge-loss machine, by dual coordinate descent; classes weigh the same."""
    w, alpha = np.zeros(x.shape[1] + 1, np.float64), np.zeros(len(x))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    upper, norm = c * 0.5 / np.maximum(share, 1e-9), np.einsum("ij,ij->i", x, x) + 1.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w[:-1] + w[-1]) - 1
            a = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[:-1] += step * x[i]
                w[-1] += step
                alpha[i] = a
    return w


class Model:
    """Families, languages, and one column of weights per linear machine."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(l) for l in self.langs})
        self.members = {f: [l for l in self.langs if family_of(l) == f] for f in self.families}
        lang, columns, self.place = np.array(langs), [], {}
        of = np.array([family_of(l) for l in langs])
        for f in self.families if len(self.families) > 1 else ():
            self.place[f] = len(columns)
            columns.append(linear_svm(x, np.where(of == f, 1.0, -1.0)))
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                pick = (lang == a) | (lang == b)
                self.place[a, b] = len(columns)
                columns.append(linear_svm(x[pick], np.where(lang[pick] == a, 1.0, -1.0)))
        weights = np.stack(columns, 1) if columns else np.zeros(((1 << BITS) + 1, 0))
        self.weights = np.rint(weights * WEIGHT_UNIT)
        self.weights[-1] *= UNIT

    def predict(self, counts: list[np.ndarray | None]) -> list[tuple[str, float]]:
        """Language and score of each text; a text without letters (None) is unknown."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(counts)
        known = [i for i, c in enumerate(counts) if c is not None]
        for at in range(0, len(known), BLOCK):
            some = known[at : at + BLOCK]
            x = np.stack([np.rint(_unit(counts[i]).astype(np.float64) * UNIT) for i in some])
            margins = (x @ self.weights[:-1] + self.weights[-1]) / (UNIT * WEIGHT_UNIT)
            sure = 1 / (1 + np.exp(-4.0 * margins))
            # machines of families come first, in the order of their names
            family = np.argmax(margins[:, : len(self.families)], 1) if len(self.families) > 1 else np.zeros(len(some), np.int64)
            for i, f, m, s in zip(some, family, margins, sure):
                out[i] = self._within(self.families[f], float(s[f]) if len(self.families) > 1 else 1.0, m, s)
        return out

    def _within(self, family: str, p: float, margin: np.ndarray, sure: np.ndarray) -> tuple[str, float]:
        """The language of a text of this family, by votes of its machines."""
        members = self.members[family]
        if len(members) == 1:
            return members[0], p
        votes, mean = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            k = self.place[a, b]
            votes[a if margin[k] >= 0 else b] += 1
            mean[a] += float(sure[k])
            mean[b] += 1 - float(sure[k])
        winner = max(members, key=lambda l: (votes[l], mean[l], l))
        return winner, p * mean[winner] / (len(members) - 1)


def drawn_at(key: Column, n: Column, want: int) -> Column:
    """Whether a text takes part in a draw of somewhat more than twice ``want`` out of n; in doubles, as n has no bound."""
    return F.pmod(F.xxhash64(key, F.lit("language sample")), F.lit(1 << 30)).cast("double") * n.cast("double") < F.lit(float((2 * want + 20) << 30))


def fit(labelled: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, in_all: int = TEXTS_IN_ALL) -> Model | None:
    """Fit on a bounded sample of (text, lang); whole texts are counted on the executors, only hashed counts come here."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("hash"))
    sizes = stage_table(labelled.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")), "languages")
    if (languages := sizes.count()) == 0:
        return None
    want = max(1, min(per_language, in_all // languages))
    # about twice as many as wanted by a threshold, then the first of them; a text counts once, however often it is there
    drawn = labelled.select("lang", "hash").join(checked_broadcast(sizes), "lang").where(drawn_at(F.col("hash"), F.col("n"), want)).select("lang", "hash").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    drawn = stage_table(drawn.withColumn("place", place).where(F.col("place") <= want).select("lang", "hash"), "drawn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, done = Features(), set()
        for part in slices(batches):
            langs, hashes, grams, times = [], [], [], []
            for text, lang, h in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), part.column("hash").to_pylist()):
                if (lang, h) not in done and (c := made.counts(text)) is not None:
                    done.add((lang, h))
                    at = np.flatnonzero(c)
                    langs.append(lang)
                    hashes.append(h)
                    grams.append(at.astype(np.int32))
                    times.append(c[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(grams, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["lang", "hash", "gram", "times"])

    rows = labelled.join(checked_broadcast(drawn), ["lang", "hash"]).mapInArrow(count, "lang string, hash long, gram array<int>, times array<int>")  # max(in_all, languages) rows
    rows = rows.groupBy("lang", "hash").agg(F.any_value(F.struct("gram", "times")).alias("c")).select("lang", "hash", "c.*").toArrow().sort_by([("lang", "ascending"), ("hash", "ascending")])
    if rows.num_rows == 0:
        return None
    x = np.zeros((rows.num_rows, 1 << BITS), np.float32)
    for i in range(rows.num_rows):
        x[i, rows["gram"][i].values.to_numpy()] = rows["times"][i].values.to_numpy()
        x[i] = _unit(x[i])
    return Model(x, rows["lang"].to_pylist())


def _counted(texts: list[str | None], made: Features, model: Model | None) -> list[tuple[str, float]]:
    return [(UNKNOWN, 0.0)] * len(texts) if model is None else model.predict([None if t is None else made.counts(t) for t in texts])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (8192 + 1) numbers for each machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for part in slices(batches):
            found = _counted(part.column("text").to_pylist(), made, shared.value)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], [*part.schema.names[:-1], "lang_pred", "score"])

    kept = docs.select(*(c for c in docs.columns if c != "text"), "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out():
    """Documents that no model may learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the documents that are not held out, applied to all."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return identify(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model)


def keep(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose language is predicted with a score of ``least``; ``lang`` becomes the prediction."""
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Features] = []

    @F.pandas_udf("lang string, score double")
    def found(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Features())
        return pd.DataFrame(_counted([t if isinstance(t, str) else None for t in texts], made[0], shared.value), columns=["lang", "score"])

    once = found.asNondeterministic()  # or the filter and the column would each run it
    judged = docs.withColumn("__found", once("text")).where((F.col("__found.lang") != UNKNOWN) & (F.col("__found.score") >= least))
    return judged.withColumn("lang", F.col("__found.lang")).drop("__found")
