"""Best-fit packing by sums of squares.

Documents are token ids and an end id; those longer than a sequence are cut so that only their first piece may be
shorter. A piece of full length is a sequence of its own. Each other piece goes, longest first, where the sum over
residual gaps of the squared number of open sequences with that gap becomes smallest; a new sequence is opened only if
no open one has room. Pieces are dealt to groups by a hash, groups of a bounded number of pieces are packed apart, and
sequences that were left with much room are taken apart and dealt anew, until one group is left: so no task grows with
the input, and groups cost no sequences.

Defined results: a null or empty text is its end id alone; null ids are kept; rows that repeat an id are packed like
any other rows; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._common import slices, stage_table
from meridia.llm._tokens import encoder

CAPACITY = 2048
END_ID = 0
#: Pieces of one group on average.
GROUP = 3000
#: A sequence with more room than this share of its capacity is taken apart for the next round.
LOOSE = 1 / 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document. ``tokenizer``: a file every executor has."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for part in slices(batches):
            rows: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = known.encode(text) + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(rows, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(rows)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Of each length its sequence (numbered from 0) and its place there."""
    bin_of, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        here = count[n:]
        fits = np.flatnonzero(here)
        if len(fits):
            after = count[fits]  # open sequences that have the gap left afterwards
            change = 2 * (after - here[fits]) + 2
            change[fits == 0] = 1 - 2 * here[0]
            gap = n + int(fits[change.argmin()])
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b, opened = capacity, opened, opened + 1
        bin_of[i], place[i] = b, capacity - gap
        if gap > n:
            stacks[gap - n].append(b)
            count[gap - n] += 1
    return bin_of, place


def _pack_group(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], ignore_index=True)
    pdf["bin"], pdf["offset"] = pack_lengths(pdf["length"].to_numpy())
    pdf["used"] = pdf.groupby("bin")["length"].transform("sum")
    pdf["g"] = key[0]
    return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "row", "g", "bin", "offset", "used"]]


def pack(pieces: DataFrame, group: int = GROUP, loose: float = LOOSE) -> DataFrame:
    """pieces with sequence_id (a number) and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = stage_table(pieces.select(*columns), "pieces")
    full = pieces.where(F.col("length") == CAPACITY)
    alone = full.select(*columns, F.monotonically_increasing_id().alias("n"), F.lit(0).cast("long").alias("offset"))
    done = [stage_table(alone.select(*columns, F.col("n").alias("sequence_id"), "offset"), "whole")]
    free = 1 + (done[0].agg(F.max("sequence_id")).first()[0] or 0)  # numbers from here on are not used yet
    rest, turn = pieces.where(F.col("length") < CAPACITY).withColumn("row", F.monotonically_increasing_id()), 1
    rest = stage_table(rest, "rest")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, g long, bin long, offset long, used long"
    while n := rest.count():
        groups = -(-n // group)
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        packed = stage_table(dealt.groupBy("g").applyInPandas(_pack_group, schema), "packed")
        name = (F.lit(free) + F.col("bin") * groups + F.col("g")).alias("sequence_id")
        free += (packed.agg(F.max("bin")).first()[0] + 1) * groups
        last = groups == 1
        tight = packed if last else packed.where(CAPACITY - F.col("used") <= CAPACITY * loose)
        done.append(tight.select(*columns, name, "offset"))
        if last:
            break
        left = stage_table(packed.where(CAPACITY - F.col("used") > CAPACITY * loose).select(*columns, "row"), "loose")
        if left.count() > 0.8 * n:  # what is left does not pack tighter
            done.append(packed.where(CAPACITY - F.col("used") > CAPACITY * loose).select(*columns, name, "offset"))
            break
        rest, turn = left, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(cut_pieces(docs, tokenizer or default_tokenizer()))
