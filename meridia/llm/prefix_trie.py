"""The trie of conversations that share beginnings, as intervals of their sorted order, without building a tree or a stack.

A turn is a symbol of 20 bytes: half a SHA-256 of role and text, and its number of words; a conversation is the string of its
symbols. Equal strings are one with a count. Strings are sorted by ranges and cut into blocks of about ``BLOCK_TURNS`` turns.
In a block, sparse tables over the common prefixes of neighbours (LCPs) and over the smallest ids answer range minima in
constant time; every candidate prefix (string i, depth d) searches its left and right extents on its own, by halving steps, and
the extents are the interval of its members. Counts are differences of running sums over the interval.

A prefix that goes on in the next block is a prefix of the block's first or last string; each block gives its part of
such nodes, and the parts are added up by a digest of the prefix. There is at most the depth of two strings of them a block.

Texts are read once and never shuffled: only symbols are. A conversation's symbols meet in one row (a million turns are 20 MB).
Ids of equal conversations are joined in pieces of ``IDS`` and then hashed in order by one task a class, as SHA-256 goes from
left to right; that task reads a row for each ``IDS`` ids and holds one of them.

Defined results: a null role or text is empty, as is an unknown turn's place (it comes first); rows without a conversation id
belong to none and are left out; turns of equal number go by the digest of role and text, and repeated rows are turns of their own;
an empty table has no nodes, not even a root; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._common import WORD_PATTERN, checked_broadcast, stage_table

#: Bytes of a turn's symbol: the digest, then the number of words.
DIGEST, SYMBOL = 16, 20
#: Turns of a block (one longer conversation is a block of its own), and ids of a piece.
BLOCK_TURNS, IDS = 200_000, 4096
NOBODY = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def symbols(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation as the string of its turns' symbols, in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD_PATTERN))), 8, "0")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.concat(digest, words).alias("symbol"))
    ordered = F.array_sort(F.collect_list(turn), lambda a, b: _before(a, b))
    out = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(ordered.alias("l"))
    return out.select("conv_id", F.unhex(F.array_join(F.transform("l", lambda t: t.symbol), "")).alias("turns"))


def _before(a, b):
    """By turn, null first, then by symbol."""
    first = F.when(a.turn.isNull() & b.turn.isNull(), 0).when(a.turn.isNull(), -1).when(b.turn.isNull(), 1).when(a.turn < b.turn, -1).when(a.turn > b.turn, 1).otherwise(0)
    return F.when(first != 0, first).when(a.symbol < b.symbol, -1).when(a.symbol > b.symbol, 1).otherwise(0)


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of c - c % 20 for its own, h = crc32(c) % 4."""
    turns = stage_table(turns, "turns")
    base = turns.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.substring("turns", 1, 3 * SYMBOL).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int") * SYMBOL
    head = F.coalesce(F.expr("head"), F.unhex(F.lit("")))
    both = turns.withColumn("base", F.expr("conv_id - conv_id % 20")).join(base, "base", "left")
    return both.select("conv_id", F.concat(F.substr(head, F.lit(1), h), F.substr("turns", h + 1)).alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (turns, conv_id) -> for at most IDS equal strings one row, with their ids joined by commas."""
    names = ["turns", "least", "n", "ids"]
    now, held, rows = None, [], []

    def close():
        if held:
            rows.append((now, held[0], len(held), ",".join(map(str, held))))
            held.clear()

    for batch in batches:
        for turns, conv in zip(batch.column("turns").to_pylist(), batch.column("conv_id").to_pylist()):
            if turns != now or len(held) >= IDS:
                close()
                now = turns
            held.append(conv)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (turns, least) -> one row a string: how many conversations, the smallest, the digest of their ids."""
    names, types = ["turns", "n", "least", "ends"], (pa.binary(), pa.int64(), pa.int64(), pa.string())
    now, n, least, digest, rows = None, 0, 0, None, []
    for batch in batches:
        for turns, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("turns", "least", "n", "ids"))):
            if digest is None or turns != now:
                if digest is not None:
                    rows.append((now, n, least, digest.hexdigest()))
                now, n, least, digest = turns, 0, first, hashlib.sha256()
            else:
                digest.update(b",")
            n += count
            digest.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, n, least, digest.hexdigest()), types)], names)


def classes(convs: DataFrame) -> DataFrame:
    """(conv_id, turns) -> (turns, n, least, ends), a row a distinct string."""
    convs = stage_table(convs, "convs")
    pieces = convs.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id").mapInArrow(_pieces, "turns binary, least long, n long, ids string")
    return pieces.repartition("turns").sortWithinPartitions("turns", "least").mapInArrow(_joined, "turns binary, n long, least long, ends string")


def blocks(distinct: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Distinct strings in ranges of their order, numbered by block: (block, turns, n, least, ends). Written down once, as
    ranges come from a sample and a task that runs again must not see others."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, room = TaskContext.get().partitionId() << 32, block_turns
        for batch in batches:
            numbers = []
            for turns in batch.column("turns"):
                size = len(turns.as_buffer()) // SYMBOL + 1
                if size > room < block_turns:
                    block, room = block + 1, block_turns
                room -= size
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], ["block", *batch.schema.names])

    ordered = stage_table(distinct, "distinct").repartitionByRange("turns").sortWithinPartitions("turns")
    return stage_table(ordered.mapInArrow(number, "block long, turns binary, n long, least long, ends string"), "blocks")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, before, first) -> (block, lcp) with the string before it; -1 for the first block."""
    for batch in batches:
        out = [-1 if a is None else len(os.path.commonprefix([a, b])) // SYMBOL for a, b in zip(batch.column("before").to_pylist(), batch.column("first").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.int64())], ["block", "lcp"])


def edges(numbered: DataFrame) -> DataFrame:
    """(block, lcp_in, lcp_out): common turns with the string before and behind the block. One row a block meets in one task."""
    ends = numbered.groupBy("block").agg(F.min("turns").alias("first"), F.max("turns").alias("last"))
    order = Window.orderBy("block")
    lcp = ends.select("block", F.lag("last").over(order).alias("before"), "first").mapInArrow(_edges, "block long, lcp long")
    return stage_table(lcp.select("block", F.col("lcp").alias("lcp_in"), F.coalesce(F.lead("lcp").over(order), F.lit(-1)).alias("lcp_out")), "edges")


class Block:
    """The strings of one block, sorted, with LCPs, range minima and running sums."""

    def __init__(self, turns: list[bytes], n: np.ndarray, least: np.ndarray, lcp_in: int, lcp_out: int):
        m = len(turns)
        self.turns, self.least, self.lcp_in, self.lcp_out, self.last = turns, least, lcp_in, lcp_out, m - 1
        self.size = np.array([len(t) // SYMBOL for t in turns], np.int64)
        table = np.frombuffer(b"".join(turns), np.uint8).reshape(-1, SYMBOL)
        self.words = np.ascontiguousarray(table[:, DIGEST:]).view(">u4").ravel().astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.lcp = self._lcp(np.ascontiguousarray(table).view(f"V{SYMBOL}").ravel())
        self.lcp[0] = lcp_in
        self.low, self.smallest = self._table(self.lcp), self._table(least)
        self.upto_n = np.concatenate([[0], np.cumsum(n)])
        behind = np.append(self.lcp[1:], lcp_out)
        self.upto_leaves = np.concatenate([[0], np.cumsum(behind < self.size)])

    def _lcp(self, symbol: np.ndarray) -> np.ndarray:
        short = np.minimum(self.size[1:], self.size[:-1])
        at = np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
        differ = symbol[np.repeat(self.begin[1:], short) + at] != symbol[np.repeat(self.begin[:-1], short) + at]
        out = short.copy()
        where = np.flatnonzero(differ)
        row = np.repeat(np.arange(len(short)), short)[where]
        np.minimum.at(out, row, at[where])
        return np.concatenate([[0], out])

    @staticmethod
    def _table(values: np.ndarray) -> list[np.ndarray]:
        out = [values]
        while 2 ** len(out) <= len(values):
            half = 2 ** (len(out) - 1)
            out.append(np.minimum(out[-1][:-half], out[-1][half:]))
        return out

    def left(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first string of those up to i that share ``depth`` turns with it."""
        at = i.copy()
        for k in range(len(self.low) - 1, -1, -1):
            to = at - 2**k
            step = to >= 0
            step[step] = self.low[k][to[step] + 1] >= depth[step]
            at[step] = to[step]
        return at

    def right(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last string of those from i on that share ``depth`` turns with it."""
        at = i.copy()
        for k in range(len(self.low) - 1, -1, -1):
            to = at + 2**k
            step = to <= self.last
            step[step] = self.low[k][at[step] + 1] >= depth[step]
            at[step] = to[step]
        return at

    def smallest_id(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        level = np.frexp(right - left + 1)[1] - 1
        out = np.empty(len(left), np.int64)
        for k in np.unique(level):
            at, t = level == k, self.smallest[k]
            out[at] = np.minimum(t[left[at]], t[right[at] - 2**k + 1])
        return out

    def nodes(self) -> dict[str, np.ndarray]:
        """Every prefix that begins in the block (``starts``), and those of the first string that began before it, in the order
        of the trie. ``open``: it goes on in another block, and the numbers are this block's part."""
        first = np.append(0, self.lcp[1:] + 1)
        count = self.size - first + 1
        offset = np.cumsum(count) - count
        i = np.repeat(np.arange(self.last + 1), count)
        depth = np.arange(len(i)) - offset[i] + first[i]
        starts = (i > 0) | (depth > self.lcp_in)
        right = self.right(i, depth)
        is_open = ~starts | ((right == self.last) & (depth <= self.lcp_out))
        # the parent is one turn shorter: of the same string, unless an earlier string has it too; then its own search to the left
        parent = np.arange(len(i)) - 1
        high = np.flatnonzero(np.arange(len(i)) == offset[i])[1:]
        begin = self.left(i[high], depth[high] - 1)
        parent[high] = offset[begin] + depth[high] - 1 - first[begin]
        children = np.zeros(len(i), np.int64)
        linked = starts & (depth > 0)
        np.add.at(children, parent[linked], 1)
        n = self.upto_n[right + 1] - self.upto_n[i]
        words = np.zeros(len(i), np.int64)
        words[depth > 0] = self.words[self.begin[i[depth > 0]] + depth[depth > 0] - 1]
        value = np.where(is_open, 0, (n - 1) * words)
        upto = np.concatenate([[0], np.cumsum(value)])
        ends = np.append(offset[1:], len(i))
        return {
            "i": i, "depth": depth, "starts": starts, "open": is_open, "parent": parent, "words": words, "n": n, "least": self.smallest_id(i, right), "children": children,
            "leaves": self.upto_leaves[right + 1] - self.upto_leaves[i], "saved": upto[ends[right]] - upto[:-1], "whole": depth == self.size[i],
        }


_PARTS = "block long, key binary, parent_key binary, open boolean, starts boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"


def _block_nodes(table: pa.Table) -> pa.Table:
    table = table.sort_by("turns")
    turns, ends = table.column("turns").to_pylist(), np.array(table.column("ends").to_pylist(), object)
    block = Block(turns, table.column("n").to_numpy(), table.column("least").to_numpy(), table.column("lcp_in")[0].as_py(), table.column("lcp_out")[0].as_py())
    x = block.nodes()
    count = len(x["i"])
    keys = np.full(count, None, object)
    for k in np.flatnonzero(x["open"]).tolist():
        keys[k] = (int(x["i"][k]), int(x["depth"][k]))
    # an open prefix is one of the first or the last string: one pass over each gives all digests
    for i in {k[0] for k in keys if k is not None}:
        running, at = hashlib.sha256(), 0
        for k in np.flatnonzero(x["open"] & (x["i"] == i)).tolist():
            upto = int(x["depth"][k]) * SYMBOL
            running.update(turns[i][at:upto])
            at = upto
            keys[k] = running.digest()
    parent_key = np.where((x["depth"] > 0) & x["starts"], keys[x["parent"]], None)
    parent_open = x["open"][x["parent"]]
    known = x["starts"] & (x["depth"] > 0) & ~parent_open
    columns = {
        "block": table.column("block").to_numpy()[:1].repeat(count), "key": keys, "parent_key": parent_key, "open": x["open"], "starts": x["starts"], "depth": x["depth"], "conv_id": x["least"],
        "parent_conv_id": pa.array(x["least"][x["parent"]], mask=~known), "n_convs": x["n"], "n_children": x["children"], "n_leaves": x["leaves"], "saved_tokens": x["saved"], "words": x["words"],
        "ends_sha256": np.where(x["starts"], np.where(x["whole"], ends[x["i"]], NOBODY), None),
    }
    types = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in _PARTS.split(", ")]
    return pa.table([pa.array(columns[n], types[t]) if isinstance(columns[n], np.ndarray) else columns[n] for n, t in fields], names=[n for n, _ in fields])


def _whole_nodes(parts: DataFrame, numbered_edges: DataFrame) -> DataFrame:
    """The nodes that go through several blocks, added up from their parts; (key, parent_key, ends_sha256 and COLUMNS)."""
    one = parts.where("open").groupBy("key").agg(
        F.min("block").alias("from"), F.max("block").alias("to"), F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("inside"), F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"),
    )
    one = stage_table(one.withColumn("value", (F.col("n_convs") - 1) * F.col("words")), "open")
    # in the order of the trie (first block, depth), what lies below a node are those that begin from it on and before its last block
    begun = one.groupBy(F.col("from").alias("block")).agg(F.sum("value").alias("v"))
    so_far = numbered_edges.select("block").join(begun, "block", "left").select("block", F.coalesce(F.sum("v").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c"))
    so_far = stage_table(so_far, "so-far")
    above = F.coalesce(F.sum("value").over(Window.partitionBy("from").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = one.withColumn("above", above).join(so_far.select(F.col("block").alias("from"), F.col("c").alias("c_from")), "from").join(so_far.select(F.col("block").alias("to"), F.col("c").alias("c_to")), "to")
    at = at.withColumn("saved_tokens", F.col("inside") + F.col("c_to") - F.col("c_from") - F.col("above"))
    ids = one.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return at.join(ids, "parent_key", "left").select("key", *COLUMNS, "ends_sha256")


def trie(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, turns as symbols) -> a row a node: COLUMNS and ends_sha256."""
    numbered = blocks(classes(convs), block_turns)
    around = edges(numbered)
    schema = _PARTS
    parts = stage_table(numbered.join(around, "block").groupBy("block").applyInArrow(_block_nodes, schema), "nodes")
    whole = stage_table(_whole_nodes(parts, around), "whole")
    ids = checked_broadcast(whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up")))
    inner = parts.where("NOT open").join(ids, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    return inner.select(*COLUMNS, "ends_sha256").unionByName(whole.select(*COLUMNS, "ends_sha256"))


def query(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(symbols(conversations)))


#: Paths as lists of digests; each node is met again by every prefix of it.
SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), marked AS (
  SELECT conv_id, p, sha256(length(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns
), heads AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM (SELECT DISTINCT conv_id FROM marked)
), cut AS (SELECT conv_id, (4294967295 - crc) % 4 AS h FROM heads
), built AS (
  SELECT c.conv_id, m.p AS place, m.k, m.words FROM cut c JOIN marked m ON m.conv_id = c.conv_id - c.conv_id % 20 AND m.p <= c.h
  UNION ALL SELECT c.conv_id, m.p + 4 AS place, m.k, m.words FROM cut c JOIN marked m ON m.conv_id = c.conv_id AND m.p > c.h
), lists AS (
  SELECT c.conv_id, coalesce(l.ks, []) AS ks, coalesce(l.ws, []) AS ws FROM cut c
  LEFT JOIN (SELECT conv_id, list(k ORDER BY place) AS ks, list(words ORDER BY place) AS ws FROM built GROUP BY conv_id) l USING (conv_id)
), prefixes AS (
  SELECT conv_id, d AS depth, array_to_string(ks[1:d], ',') AS path, array_to_string(ks[1:d - 1], ',') AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(ks) AS whole
  FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM lists)
), nodes AS (
  SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, path
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children FROM nodes n
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.up AND n.depth > 0
  LEFT JOIN (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL) k ON k.depth = n.depth AND k.path = n.path
), below AS (
  SELECT e AS depth, left(path, greatest(0, 65 * e - 1)) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS e FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs, c.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b USING (depth, path)
"""
