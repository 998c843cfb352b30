"""Quality by data-selection importance resampling.

Two bag-of-n-grams models over hashed uni- and bigrams of words: one of target texts (labelled good), one of all raw
texts. A text's log importance weight is the sum over its n-grams of log p_target - log p_raw. Sampling without
replacement in proportion to the weights is a top-k of log weight plus Gumbel noise.

The sum grows with length, so that noise would mean nothing for long texts; weights are taken per n-gram, times SCALE
(the temperature of the sample). Noise is a hash of the id, so reruns agree. The raw model counts all documents; the
target model counts a bounded sample of labelled ones.

Defined results: a text without words (null and empty ones too) has log weight null and is not kept; with no target text
all weights are 0; rows that repeat an id have the same noise, and so have all null ids together; rows equal in id,
weight and number of n-grams are kept or left together (the sample may then be smaller by one such group); an empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._common import checked_broadcast, slices, stage_table
from meridia.llm._shingles import WordHashes, mix
from meridia.llm.prefix_cut import position, prefix_cut
from meridia.llm.source_mix import uniform

BUCKETS = 1 << 14
#: The share of documents with words that is kept, and the temperature.
KEEP, SCALE = 0.8, 40.0
#: Bound of the target sample, as labelled documents.
TARGET_TEXTS = 20_000
SMOOTH = 0.5


def grams(words: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]
    return (np.concatenate([mix(words), pairs]) >> np.uint64(64 - 14)).astype(np.int64)


def target_ids(labels: DataFrame, bound: int = TARGET_TEXTS) -> DataFrame:
    """At most about ``bound`` ids of documents labelled good (and not toxic), drawn by a hash of the id."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    share = min(1.0, bound / max(1, good.count()))
    return good.where(F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1 << 30)) < int((1 << 30) * share)).withColumn("target", F.lit(True))


def fit(docs: DataFrame, targets: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket; counts are summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, raw, good = WordHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in slices(batches):
            for found, target in zip(words.of_many(part.column("text").to_pylist()), part.column("target").to_pylist()):
                c = np.bincount(grams(found), minlength=BUCKETS)
                raw += c
                if target:
                    good += c
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    marked = docs.join(checked_broadcast(targets), "doc_id", "left").select("text", "target")
    counts = np.zeros((2, BUCKETS))
    for r in marked.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # BUCKETS rows
        counts[:, r.bucket] = r.good, r.raw
    if counts[0].sum() == 0:
        return np.zeros(BUCKETS)
    p = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
    return np.log(p[0]) - np.log(p[1])


def weigh(docs: DataFrame, ratio: np.ndarray, scale: float = SCALE) -> DataFrame:
    """doc_id, n_grams, log_weight of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in slices(batches):
            n, w = [], []
            for found in words.of_many(part.column("text").to_pylist()):
                g = grams(found)
                n.append(len(g))
                w.append(float(shared.value[g].mean() * scale) if len(g) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(w, pa.float64())], ["doc_id", "n_grams", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: str = "gumbel") -> DataFrame:
    """doc_id, n_grams, log_weight, kept of each row of docs: kept are the top-k by log weight plus Gumbel noise."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = weigh(docs, fit(docs, target_ids(labels)))
    u = F.greatest(uniform(F.col("doc_id"), seed), F.lit(2.0**-60))
    noisy = F.col("log_weight") - F.log(-F.log(u))
    # the key falls as the noisy weight grows, within [0, 1)
    rows = stage_table(rows.withColumn("key", F.least(F.lit(0.5) - F.atan(noisy / SCALE) / F.lit(np.pi), F.lit(1 - 2.0**-52))).withColumn("g", F.lit(0)), "weights")
    live = rows.where("log_weight IS NOT NULL")
    k = int(live.count() * keep)
    rooms = docs.sparkSession.range(1).select(F.lit(0).alias("g"), F.lit(k).cast("long").alias("room"))
    ties = ("doc_id", "n_grams")
    cuts = prefix_cut(live.withColumn("one", F.lit(1).cast("long")), rooms, "g", "key", "one", ties)
    rows = rows.join(checked_broadcast(cuts), "g", "left")
    kept = F.col("log_weight").isNotNull() & (F.col("cut_at").isNull() | (position("key", ties) < F.col("cut_at")))
    return rows.select("doc_id", "n_grams", "log_weight", kept.alias("kept"))
