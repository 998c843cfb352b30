"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, one representative a group.

Centroids are fitted on a bounded sample of unit vectors; every vector belongs to the cell of its nearest centroid and
visits each cell of smaller number that can hold a partner of it. Vectors are compared inside (label, cell), in blocks of
rows, in double precision: members with members and with visitors. A block yields counts of links per vector and a
spanning forest of its links, never the pairs. Components are then joined across blocks.

A member x of cell c is no nearer to the centroid of y's own cell o, so x (c - o) >= 0; if x is within the angle t of y,
then y (o - c) <= s sin(t) |o - c|, where s is the cosine of y - x to the line between the centroids. In d dimensions that is
rarely above REACH / sqrt(d), and cells for which the inequality fails with this s are left out; ``query`` does so. ``exact`` (the
default of ``near_duplicates``) takes s = 1, which holds always, but then a vector without clusters visits about half of the
cells. Each linked pair that meets does so once: in the cell of smaller number of the two. Measured recall of links with REACH
is 0.99 on vectors without clusters in 16 to 256 dimensions and inside one dense group (a test holds it above 0.97); pairs
that are found are exact. Tables of at most CELL_ROWS vectors are one cell, so nothing is left out there. Inside a dense
group all pairs are links, which are counted one by one.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component, or whose label is null,
links with nothing (0 links, its own component, kept); vectors of different lengths link with nothing of the other
length; equal vectors of a label are compared as one with a weight (told apart by 128 bits of hashes), and link with each
other; rows that repeat a vec_id count as one vector, the first by label and content; rows without a vec_id are one row of
the result with 0 links; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._common import checked_broadcast, stage_table
from meridia.llm._components import connected_components

COSINE = 0.93
#: Vectors a cell should hold, and the most cells.
CELL_ROWS, MOST_CELLS = 4000, 4096
#: Bound of the sample that centroids are fitted on, as vectors.
SAMPLE = 20_000
#: Standard deviations of a random direction's share along a given one: how far a partner is looked for.
REACH = 2.5
#: Allowance for rounding when cells are left out: it can only add visits.
ROUNDING = 1e-6
#: Rows of one block; a larger cell is compared block by block, each pair of blocks in a task of its own.
BLOCK = 4096


def _units(v: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k unit centroids of unit rows x."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centre)
    return centre


def fit_cells(vectors: DataFrame, cell_rows: int, most_cells: int, sample: int) -> np.ndarray | None:
    """Centroids for the most frequent length of vectors; None if one cell is enough. vectors: (vec_id, v, dim)."""
    lengths = vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not lengths or lengths[0].n <= cell_rows:
        return None
    dim, n = lengths[0].dim, lengths[0].n
    chosen = vectors.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("vec_id", F.lit("cells")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n)))
    rows = chosen.orderBy(F.xxhash64("vec_id")).limit(2 * sample).select("v").toArrow()["v"]
    x = np.asarray(rows.combine_chunks().values, np.float64).reshape(len(rows), dim)
    return spherical_kmeans(_units(x), min(most_cells, -(-n // cell_rows)))


def reached(v: np.ndarray, c: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the nearest cell, and which cells of smaller number it visits."""
    near = _units(v) @ c.T
    home, norms = near.argmax(1), (c * c).sum(1)
    apart = np.sqrt(np.maximum(norms[home][:, None] + norms - 2 * c[home] @ c.T, 0))
    slack = float(np.sqrt(1 - COSINE**2)) * (1.0 if exact else min(1.0, REACH / np.sqrt(c.shape[1])))
    return home, (near[np.arange(len(v)), home][:, None] - near <= slack * apart + ROUNDING) & (np.arange(len(c)) < home[:, None])


def _visits(vectors: DataFrame, centre: np.ndarray | None, exact: bool) -> DataFrame:
    """vectors with ``cells``: the own cell first, then those visited; other lengths share one cell."""
    if centre is None:
        return vectors.withColumn("cells", F.array(F.lit(0)))
    shared = vectors.sparkSession.sparkContext.broadcast(centre)  # at most MOST_CELLS centroids

    @F.pandas_udf("array<int>")
    def reach(rows: pd.Series) -> pd.Series:
        c, out = shared.value, [[0]] * len(rows)
        own = [i for i, r in enumerate(rows) if len(r) == c.shape[1]]
        for at in range(0, len(own), 500):
            part = own[at : at + 500]
            for i, h, m in zip(part, *reached(np.stack([rows.iloc[i] for i in part]), c, exact)):
                out[i] = [int(h), *np.flatnonzero(m).tolist()]
        return pd.Series(out)

    return vectors.withColumn("cells", reach("v"))


def _compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks (x, y) of a cell: for each vector the links counted here, and its root among them."""
    x, y = key[3], key[4]
    pdf = pdf.sort_values("vec_id", ignore_index=True)
    ids, block = pdf["vec_id"].to_numpy(), pdf["block"].to_numpy()
    v = _units(np.stack(pdf["v"].to_list()).astype(np.float64))
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    links, root, weight = np.zeros(len(ids), np.int64), np.arange(len(ids)), pdf["weight"].to_numpy()

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(left), 512):
        part = left[at : at + 512]
        i, j = np.nonzero(v[part] @ v[right].T >= COSINE)
        i, j = part[i], right[j]
        good = i < j if x == y else np.ones(len(i), bool)
        i, j = i[good], j[good]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        while len(i):  # most pairs of a dense group fall away as soon as their roots agree
            a, b = top(int(i[0])), top(int(j[0]))
            root[max(a, b)] = min(a, b)
            while (root != root[root]).any():
                root[:] = root[root]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
    own = links > 0
    while (root != root[root]).any():
        root[:] = root[root]
    return pd.DataFrame({"vec_id": ids[own], "root": ids[root[own]], "links": links[own]})


def near_duplicates(rows: DataFrame, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS, sample: int = SAMPLE, block: int = BLOCK, exact: bool = True) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept: one row for each vector. ``exact`` leaves out no cell that
    can hold a partner."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    usable = rows.where(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v").withColumn("dim", F.size("v"))
    usable = stage_table(usable.withColumn("k1", F.xxhash64(F.lit("one"), "label", "v")).withColumn("k2", F.xxhash64("v", "label", F.lit("two"))), "vectors")
    # equal vectors are one class, that of the smallest id
    classes = stage_table(usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).where("weight > 1"), "equal")
    usable = usable.join(checked_broadcast(classes), ["k1", "k2"], "left").select("vec_id", "label", "v", "dim", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"))
    usable = stage_table(usable, "classes")
    reps = usable.select("vec_id", "rep", "weight")
    usable = usable.where("vec_id = rep").drop("rep")
    placed = _visits(usable, fit_cells(usable, cell_rows, most_cells, sample), exact)
    each = placed.select("vec_id", "v", "label", "dim", "weight", F.posexplode("cells").alias("nth", "cell")).withColumn("own", F.col("nth") == 0).drop("nth")
    each = stage_table(each, "cells")
    in_blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = each.groupBy("label", "cell", "dim").agg(F.count_if("own").alias("members"), F.count_if(~F.col("own")).alias("visitors"))
    sizes = sizes.where("members > 0").select("label", "cell", "dim", in_blocks(F.col("members")).alias("blocks"), in_blocks(F.col("visitors")).alias("more"))
    # blocks of members come first, then those of visitors
    place = lambda n: F.pmod(F.xxhash64("vec_id"), n.cast("long")).cast("int")
    each = each.join(sizes, ["label", "cell", "dim"]).withColumn("block", F.when(F.col("own"), place(F.col("blocks"))).otherwise(F.col("blocks") + place(F.col("more"))))
    # the pairs of blocks that a row takes part in: a member's own with each one, a visitor's with those of members
    last = F.col("blocks") - 1 + F.when(F.col("own"), F.col("more")).otherwise(0)
    pairs = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    tasks = each.withColumn("p", F.explode(pairs)).select("label", "cell", "dim", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "vec_id", "v", "weight", "block")
    found = stage_table(tasks.groupBy("label", "cell", "dim", "x", "y").applyInPandas(_compare, "vec_id long, root long, links long"), "near")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    groups = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = rows.select("vec_id").distinct().join(reps, "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id"))
    out = out.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    links = F.coalesce("n_links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1
    out = out.select("vec_id", links.cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(rows: DataFrame) -> DataFrame:
    return near_duplicates(rows, exact=False)


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings
                     WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
m AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT m.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)"""
