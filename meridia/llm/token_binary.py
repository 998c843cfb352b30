"""Token ids in files of fixed-width packed bits, with block offsets for random access.

File (little-endian): the 8 bytes ``MTOK0001``; blocks of packed ids; a footer; the footer's length (8 bytes) and
``MTOKFOOT``. An id takes the fewest bits that number the vocabulary; 64 ids of width w fill w words of 64 bits, so
packing and unpacking are w-fold vectorised and no id depends on another. A block holds BLOCK_IDS ids (the last is padded
to 64). The footer has the width, the number of ids, each block's offset, and for each document its id, whether the id
is null, and where its ids begin.

Files are written by Spark tasks, one a range of ascending document ids, to the shared folder under a name of the
attempt's own; only the names that successful tasks report are read, so retries do no harm.

Defined results: a null or empty text has its end id alone; null ids come last; rows that repeat an id are ordered by
text (null first); an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._common import new_folder, slices, stage_table
from meridia.llm._tokens import encoder

MAGIC, FOOT = b"MTOK0001", b"MTOKFOOT"
BLOCK_IDS = 1 << 16
END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids, padded with 0 to a multiple of 64, as width words of 64 bits for each 64 ids."""
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(lanes), width), np.uint64)
    for k in range(64):
        at, shift = divmod(k * width, 64)
        words[:, at] |= lanes[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_bits(raw: bytes, n: int, width: int) -> np.ndarray:
    words = np.frombuffer(raw, "<u8").reshape(-1, width)
    lanes, mask = np.empty((len(words), 64), np.uint32), np.uint64((1 << width) - 1)
    for k in range(64):
        at, shift = divmod(k * width, 64)
        x = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, at + 1] << np.uint64(64 - shift))
        lanes[:, k] = x & mask
    return lanes.reshape(-1)[:n]


class Writer:
    """Writes one file block by block; memory holds a block and 17 bytes a document."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.at = out.write(MAGIC) or len(MAGIC)
        self.at = len(MAGIC)
        self.blocks: list[int] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.n))
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            every = np.concatenate(self.held)
            whole = len(every) - len(every) % BLOCK_IDS
            for i in range(0, whole, BLOCK_IDS):
                self._block(every[i : i + BLOCK_IDS])
            self.held, self.n_held = [every[whole:].copy()], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.width)
        self.blocks.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        head = json.dumps({"width": self.width, "ids": self.n, "blocks": len(self.blocks), "documents": len(self.docs), "block_ids": BLOCK_IDS}).encode()
        doc = np.array(self.docs, np.int64).reshape(-1, 3)
        foot = len(head).to_bytes(8, "little") + head + np.array(self.blocks, "<i8").tobytes() + doc[:, 0].astype("<i8").tobytes() + doc[:, 2].astype("<i8").tobytes() + doc[:, 1].astype(np.uint8).tobytes()
        self.out.write(foot + len(foot).to_bytes(8, "little") + FOOT)
        self.out.close()


class Reader:
    """Random access to one file: ``ids(start, end)`` reads only the blocks it needs."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != FOOT:
            raise ValueError("not a token file")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - n)
        foot = source.read(n)
        k = int.from_bytes(foot[:8], "little")
        head, at = json.loads(foot[8 : 8 + k]), 8 + k
        self.width, self.n, b, d = head["width"], head["ids"], head["blocks"], head["documents"]
        self.block_ids = head["block_ids"]
        self.blocks = np.frombuffer(foot, "<i8", b, at)
        self.doc_ids = np.frombuffer(foot, "<i8", d, at + 8 * b)
        self.starts = np.frombuffer(foot, "<i8", d, at + 8 * (b + d))
        self.null = np.frombuffer(foot, np.uint8, d, at + 8 * (b + 2 * d)).astype(bool)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n - k * self.block_ids)
        self.source.seek(int(self.blocks[k]))
        return unpack_bits(self.source.read(-(-n // 64) * self.width * 8), n, self.width)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        every = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return every[start - first * self.block_ids : end - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in order; memory holds the blocks of one document."""
        ends = np.append(self.starts[1:], self.n)
        k, held = -1, np.empty(0, np.uint32)
        for doc_id, null, a, b in zip(self.doc_ids, self.null, self.starts, ends):
            a, b = int(a), int(b)
            parts = []
            for j in range(a // self.block_ids, (b - 1) // self.block_ids + 1 if b > a else a // self.block_ids):
                if j != k:
                    k, held = j, self.block(j)
                parts.append(held[max(0, a - j * self.block_ids) : b - j * self.block_ids])
            yield (None if null else int(doc_id)), a, np.concatenate(parts) if parts else np.empty(0, np.uint32)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (a local path, or a URI that pyarrow knows) and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write docs to files of ascending ids; the manifest: (place, path, n_ids, n_documents), place ascending."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = None
        for part in slices(batches):
            if writer is None:
                known = encoder(tokenizer)
                store, base = open_fs(folder)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                store.create_dir(base, recursive=True)
                writer = Writer(store.open_output_stream(f"{base}/{name}"), width_of(max(known.vocabulary, end_id + 1)))
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                writer.add(doc_id, np.frombuffer(known.encode(text) + end, "<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([writer.n], pa.int64()), pa.array([len(writer.docs)], pa.int64())], ["place", "path", "n_ids", "n_documents"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    dealt = slim.repartitionByRange(partitions, order) if partitions else slim.repartitionByRange(order)
    return stage_table(dealt.sortWithinPartitions(order, F.col("text").asc_nulls_first()).mapInArrow(run, "place int, path string, n_ids long, n_documents long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32 of every document, unpacked from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, at = open_fs(path)
                reader = Reader(store.open_input_file(at))
                rows: list[list] = [[], [], [], []]
                for doc_id, start, ids in reader.documents():
                    for column, value in zip(rows, (doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        column.append(value)
                    if len(rows[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stage_table(manifest.select("path", before.alias("base")), "bases")  # one row a file
    return placed.repartition(max(1, min(1000, placed.count())), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_files(write_files(docs, new_folder(docs.sparkSession, "tokens"), tokenizer or default_tokenizer()))
