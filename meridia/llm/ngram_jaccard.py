"""Exact n-gram Jaccard self-join by universe-partition pigeonhole.

A document is its set of distinct 5-word shingles (64-bit hashes). Equal sets are one class and are joined once.
The hash universe is cut into m equal segments, m by size band, so a set is m sub-sets. If J(A, B) >= 0.8, the two sets
differ in at most H = floor((|A| + |B|) / 9) shingles, hence in at most H segments. Segments are ordered by cost: those
whose content is common in the corpus come last (a fixed-size count over all documents), among the others those with
more shingles first. The cheapest segment that both sets share is among the H + 1 cheapest of either, so each set
indexes that subset only, for its own band and, as the larger partner, for the band below. Small sets (at most 14
shingles) are one segment with its deletion neighbourhood: one deletion suffices up to 9 shingles, two up to 14.

Buckets of a signature are not expanded into all pairs. First all members are held against the bucket's centre, the
one with the most members in its buckets: in a group of near copies that is the text they come from, and most links
of the group meet in it. After that, rounds take pivots, at first one of a component, and hold the members of other
components against them. Rounds go on until no bucket holds an unseen pair of different components, so no link between
different components is lost. Before sets are fetched, a parity sketch (512 bits, the
parity of the number of shingles in each part of the universe) drops pairs that certainly differ in more than H
shingles: sets differ at least where sketches do. Verification is exact, on the whole sets.

Defined results: a null or empty text has no shingles, links with nothing and is its own component; a text with a null
id links like others, but its id counts for nothing (its component is null if no linked text has an id); rows that
repeat an id are rows of their own; an empty table gives an empty result; other columns are never looked at. Sets are
told apart by 128-bit fingerprints: a class is named by the first half, and where two classes have that in common (it is looked
for), each by the two halves combined. Rows are told apart by two 64-bit hashes of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm._common import checked_broadcast, drop_tables, slices, stage_table
from meridia.llm._components import connected_components
from meridia.llm._shingles import PARITY_BITS, WordHashes, fingerprint, mix, parity, shingle_set

PERCENT = 80
SMALL, FIRST = 14, 15
#: Cells of the count of segment contents, over the whole corpus.
COST_BITS = 14
#: A cell of signatures is crowded if it has so many times the rows of the average cell; its rows are dealt to so many parts.
CROWDED, SALTS = 8, 256
#: By round: whether a bucket's pivots are of different components or any members, and how many at most; the last repeats.
PIVOTS = (("label", 16), ("cls", 256), ("cls", 2048))
#: Rows of a broadcast list of (cls, key).
FETCHED = 1_000_000
#: Names of classes that are looked up in every task; 128-bit fingerprints of 5e10 sets have about 70 with a first half in common.
MOST_CLASHES = 100_000
SKETCH = [f"s{i}" for i in range(PARITY_BITS // 64)]


def differ(a: int, b: int) -> int:
    """The most shingles in which sets of sizes a and b with J >= 0.8 differ."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def partner(size: int) -> int:
    """The largest size that a partner of a set of this size can have."""
    return size * 100 // PERCENT


def band_of(size: int) -> int:
    return (size // FIRST).bit_length() - 1


@lru_cache(maxsize=64)
def cuts_of(band: int) -> tuple[int, np.ndarray]:
    """Segments of a band: a quarter more than its largest set has to index, and where in the universe they begin."""
    top = FIRST * 2 ** (band + 1) - 1
    need = differ(top, partner(top)) + 1
    m = need + -(-need // 4)
    return m, np.array([(k << 64) // m for k in range(1, m)], np.uint64)


def segments(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment: a hash of its number and content, and how many shingles it has."""
    m, cuts = cuts_of(band)
    edge = np.empty(m + 1, np.int64)
    edge[0], edge[-1] = 0, len(shingles)
    edge[1:-1] = np.searchsorted(shingles, cuts)
    run = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles), out=run[1:])
    sizes = np.diff(edge)
    place = np.arange(m, dtype=np.uint64) + np.uint64((band + 2) << 40)
    return mix(run[edge[1:]] - run[edge[:-1]] + mix(place) + sizes.astype(np.uint64)), sizes


def chosen(shingles: np.ndarray, band: int, need: int, heat: np.ndarray) -> np.ndarray:
    """Signatures of the ``need`` cheapest segments; empty ones are last and hardly ever needed."""
    sig, sizes = segments(shingles, band)
    if need >= len(sig):
        return sig
    cost = np.where(sizes == 0, np.uint64(255), heat[sig >> np.uint64(64 - COST_BITS)])
    key = (cost << np.uint64(56)) | ((np.uint64(255) - np.minimum(sizes, 255).astype(np.uint64)) << np.uint64(48)) | (sig >> np.uint64(16))
    return sig[np.argpartition(key, need - 1)[:need]]


def neighbourhood(shingles: np.ndarray, least: int, most: int) -> np.ndarray:
    """Hashes of the sub-sets with ``least`` to ``most`` shingles."""
    n, spread = len(shingles), mix(shingles)
    total, out = spread.sum(keepdims=True), []
    for gone in range(max(0, n - most), n - least + 1):
        if gone == 0:
            out.append(total)
        else:
            pick = np.array(list(combinations(range(n), gone)), np.int64)
            out.append(total - spread[pick].sum(1))
    return mix(np.concatenate(out) + np.uint64(1 << 40)) if out else shingles[:0]


def neighbours(shingles: np.ndarray) -> np.ndarray:
    """The deletion neighbourhood under which a small set is indexed; none for larger sets."""
    n = len(shingles)
    least = -(-n * PERCENT // 100)
    return neighbourhood(shingles, least, min(n, SMALL)) if n and least <= SMALL else shingles[:0]


def cheapest(shingles: np.ndarray, heat: np.ndarray) -> np.ndarray:
    """The segments under which a set is indexed, for its own band and for the band below; none for small sets."""
    n = len(shingles)
    if n < FIRST:
        return shingles[:0]
    band = band_of(n)
    out = [chosen(shingles, band, differ(n, partner(n)) + 1, heat)]
    top = FIRST * 2**band - 1  # the largest set of the band below
    if band and top * 100 >= n * PERCENT:
        out.append(chosen(shingles, band - 1, differ(n, top) + 1, heat))
    return np.unique(np.concatenate(out))


def signatures(shingles: np.ndarray, heat: np.ndarray) -> np.ndarray:
    """Everything under which a set is indexed. A pair with J >= 0.8 shares at least one."""
    return np.concatenate([neighbours(shingles), cheapest(shingles, heat)])


def cells_of(sig: np.ndarray) -> np.ndarray:
    return (sig >> np.uint64(64 - COST_BITS)).astype(np.int64)


def class_of(halves: tuple[int, int], clashing: frozenset[int]) -> int:
    """The name of a class by its fingerprint; ``clashing`` are first halves that several classes have."""
    one, two = halves
    return one ^ two if one in clashing else one


def _key(doc_id, text):
    return F.xxhash64(doc_id, text)


def _more(doc_id, text):
    return F.xxhash64(F.lit("more"), text, doc_id)


def _sets(docs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, key, more, n, cls, other, sketch) of every row, other being the fingerprint's second half, and what one pass over the texts counts: the heat of segment contents, and
    which cells of signatures (neighbourhoods first, then segments) are crowded."""
    half = 1 << COST_BITS
    names = ["doc_id", "key", "more", "n", "cls", "other", "cell", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cells = WordHashes(), np.zeros(2 * half, np.int64)
        for part in slices(batches):
            n, cls, other, bits = [], [], [], []
            for found in words.of_many(part.column("text").to_pylist()):
                s = shingle_set(found)
                n.append(len(s))
                one, two = fingerprint(s) if len(s) else (None, None)
                cls.append(one)
                other.append(two)
                bits.append(parity(s))
                cells[:half] += np.bincount(cells_of(neighbours(s)), minlength=half)
                if len(s) >= FIRST:
                    sig, sizes = segments(s, band_of(len(s)))
                    cells[half:] += np.bincount(cells_of(sig[sizes > 0]), minlength=half)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("more"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(other, pa.int64()), pa.nulls(len(n), pa.int32()), *map(pa.array, np.stack(bits, 1))], names)
        full = np.flatnonzero(cells)
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(cells[full], pa.int64()), none, none, pa.array(full.astype(np.int32)), *[none] * len(SKETCH)], names)

    table = stage_table(docs.mapInArrow(run, f"doc_id long, key long, more long, n long, cls long, other long, cell int, {', '.join(f'{x} long' for x in SKETCH)}"), "sets")
    count = np.zeros(2 * half, np.float64)
    for r in table.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a fixed number of cells
        count[r.cell] = r.n
    over = np.concatenate([x / max(x.sum() / half, 1e-9) for x in (count[:half], count[half:])])
    heat = np.clip(np.floor(np.log2(np.maximum(over[half:], 1.0))) - 2, 0, 100).astype(np.uint64)
    return table.where("cell IS NULL").drop("cell"), heat, over >= CROWDED


def _name():
    """A bucket's name: buckets with the same members are one."""
    return F.xxhash64("cnt", "lo", "hi", "all")


def _buckets(docs: DataFrame, heat: np.ndarray, crowded: np.ndarray, clashing: frozenset[int]) -> DataFrame:
    """Index rows of signatures that at least two classes share: pairs (lo, hi), members (bucket, cls) of larger buckets, and rows
    of crowded cells (sig, salt, cls), which are dealt to SALTS parts of a signature, with what a part sums up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = WordHashes(), set()
        for part in slices(batches):
            sigs, ids, salts, times = [], [], [], []
            for found in words.of_many(part.column("text").to_pylist()):
                s = shingle_set(found)
                if len(s) == 0 or (cls := class_of(fingerprint(s), clashing)) in done:
                    continue  # a task indexes a class once
                if len(done) >= 1_000_000:
                    done.clear()
                done.add(cls)
                near, cheap = neighbours(s), cheapest(s, heat)
                hot = crowded[np.concatenate([cells_of(near), cells_of(cheap) + (1 << COST_BITS)])]
                sigs.append(np.concatenate([near, cheap]).view(np.int64))
                salts.append(np.where(hot, 1 + cls % SALTS, 0).astype(np.int16))
                ids.append(cls)
                times.append(len(sigs[-1]))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(salts)), pa.array(np.repeat(np.array(ids, np.int64), times))], ["sig", "salt", "cls"])

    by = Window.partitionBy("sig", "salt")
    index = docs.select("text").mapInArrow(run, "sig long, salt short, cls long")
    index = index.select("sig", "salt", "cls", F.count("*").over(by).alias("cnt"), F.min("cls").over(by).alias("lo"), F.max("cls").over(by).alias("hi"), F.bit_xor(F.xxhash64("cls")).over(by).alias("all"))
    hot, pair = F.col("salt") > 0, F.col("cnt") == 2
    some = lambda c, cond: F.when(cond, F.col(c)).alias(c)
    index = index.where(hot | ((F.col("lo") != F.col("hi")) & (~pair | (F.col("cls") == F.col("lo")))))
    return stage_table(index.select(some("sig", hot), some("salt", hot), "cls", "cnt", some("lo", hot | pair), some("hi", hot | pair), some("all", hot), F.when(~hot & ~pair, _name()).alias("bucket")), "buckets")


def _large_and_pairs(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of three and more classes as (bucket, cls, cnt), and the others as pairs (a, b); crowded signatures are summed up first."""
    hot = index.where("salt IS NOT NULL")
    parts = hot.groupBy("sig", "salt").agg(*(F.any_value(c).alias(c) for c in ("cnt", "lo", "hi", "all")))
    whole = parts.groupBy("sig").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_xor("all").alias("all")).where("lo <> hi")
    whole = stage_table(whole, "crowds")
    crowds = hot.select("sig", "cls").join(whole.where("cnt > 2").select("sig", "cnt", _name().alias("bucket")), "sig")
    large = index.where("bucket IS NOT NULL").select("bucket", "cls", "cnt").unionByName(crowds.select("bucket", "cls", "cnt")).distinct()
    pairs = index.where("salt IS NULL AND bucket IS NULL").select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(whole.where("cnt = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    return large, pairs


def _may_link():
    """Of two classes with columns ..._a and ..._b: False only if their sets are certainly too different."""
    smaller, larger = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    bits = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH), F.lit(0))
    return (smaller * 100 >= larger * PERCENT) & (bits * (100 + PERCENT) <= (smaller + larger) * (100 - PERCENT))


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select(*more, F.col("cls").alias(name), F.col("n").alias(f"n_{name}"), *(F.col(c).alias(f"{c}_{name}") for c in SKETCH))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _arrays(docs: DataFrame, wanted: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """(cls, s): the whole shingle set of each class of ``wanted`` (cls, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = WordHashes(), set()
        for part in slices(batches):  # equal rows have equal keys: a task returns a class once
            ids, sets = [], []
            for cls, found in zip(part.column("cls").to_pylist(), words.of_many(part.column("text").to_pylist())):
                if cls not in done and len(s := shingle_set(found)) and class_of(fingerprint(s), clashing) == cls:
                    done.add(cls)
                    ids.append(cls)
                    sets.append(s.view(np.int64))
            if ids:
                ends = np.cumsum([0] + [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.LargeListArray.from_arrays(ends, np.concatenate(sets)).cast(pa.list_(pa.int64()))], ["cls", "s"])

    return stage_table(docs.select("key", "text").join(checked_broadcast(wanted.select("cls", "key"), FETCHED), "key").select("cls", "text").mapInArrow(run, "cls long, s array<long>"), "arrays")


def _verify(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets have J >= 0.8."""
    both = pairs.join(arrays.select(F.col("cls").alias("b"), F.col("s").alias("t")), "b").join(arrays.withColumnRenamed("cls", "a"), "a")
    shared = F.size(F.array_intersect("s", "t"))
    return stage_table(both.where(shared * 100 >= (F.size("s") + F.size("t") - shared) * PERCENT).select("a", "b"), "links")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (bucket, cls, ...) of buckets that still hold two components, with their component as ``label``."""
    labelled = members.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    return labelled.join(mixed, "bucket", "left_semi")


def _linked(docs: DataFrame, classes: DataFrame, heat: np.ndarray, crowded: np.ndarray, clashing: frozenset[int]) -> DataFrame:
    """(node, component) of the classes that link with others."""
    index = _buckets(docs, heat, crowded, clashing)
    members, pairs = _large_and_pairs(index)
    members = stage_table(members, "large")
    # the centre of a bucket is its member with the largest neighbourhood: the text that others are copies of is found early
    weight = members.groupBy("cls").agg(F.sum("cnt").alias("weight"))
    large = stage_table(members.drop("cnt").join(weight, "cls"), "weighted")
    centres = stage_table(large.groupBy("bucket").agg(F.max(F.struct("weight", "cls")).getField("cls").alias("a")), "centres")
    stars = large.join(centres, "bucket").where("a <> cls").select("a", F.col("cls").alias("b"))
    near = stage_table(_ordered(pairs.unionByName(stars)), "near")
    drop_tables(index, members)
    known = classes.select("cls", "n", *SKETCH)
    pairs = stage_table(near.join(_side(known, "a"), "a").join(_side(known, "b"), "b").where(_may_link()).select("a", "b"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "key"), "cls")
    arrays = _arrays(docs, wanted, clashing)
    links = _verify(pairs, arrays)
    found = connected_components(links)
    drop_tables(near, pairs, arrays)

    rest = stage_table(_mixed(large.join(centres.withColumnRenamed("a", "cls"), ["bucket", "cls"], "left_anti"), found), "rest")
    drop_tables(large, centres)
    if rest.isEmpty():
        return found
    arrays = _arrays(docs, rest.select("cls").distinct().join(classes.select("cls", "key"), "cls"), clashing)
    rest, old = stage_table(rest.join(known, "cls"), "rest"), rest
    drop_tables(old)
    for by, step in chain(PIVOTS, repeat(PIVOTS[-1])):
        best = F.max(F.struct("weight", "cls", "label", "n", *SKETCH)).alias("p")
        pivots = stage_table(rest.groupBy("bucket", F.pmod(F.xxhash64(by), F.lit(step)).alias("of")).agg(best).select("bucket", "p.*"), "pivots")
        one, two = _side(pivots.withColumn("la", F.col("label")), "a", "bucket", "la"), _side(rest.withColumn("lb", F.col("label")), "b", "bucket", "lb")
        more = stage_table(_ordered(one.join(two, (one.bucket == two.bucket) & (F.col("la") != F.col("lb")) & _may_link())), "more")
        fresh = _verify(more, arrays)
        if not fresh.isEmpty():
            found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh))
        rest, old = stage_table(_mixed(rest.drop("label").join(pivots.select("bucket", "cls"), ["bucket", "cls"], "left_anti"), found), "rest"), rest
        drop_tables(old, pivots, more)
        if rest.isEmpty():
            drop_tables(arrays)
            return found


def _classes(sets: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """(cls, first, n, sketch, key), a row a class, and the names that more than one fingerprint has."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "more"))
    others = (F.min("other").alias("low"), F.max("other").alias("high"))
    classes = sets.where("cls IS NOT NULL").groupBy("cls").agg(first.alias("first"), *others, *(F.any_value(c).alias(c) for c in ("n", *SKETCH)))
    classes = stage_table(classes.withColumn("key", F.col("first.key")), "classes")
    same = classes.where("low <> high").select("cls").limit(MOST_CLASHES + 1).collect()
    if len(same) > MOST_CLASHES:
        raise ValueError("fingerprints of sets are not spread: too many have their first half in common")
    return classes.drop("low", "high"), frozenset(r.cls for r in same)


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, key, more, n, cls, component_id and first, the row of its group that stays, for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", _key("doc_id", "text")).withColumn("more", _more("doc_id", "text"))
    sets, heat, crowded = _sets(docs)
    classes, clashing = _classes(sets)
    if clashing:
        sets = sets.withColumn("cls", F.when(F.col("cls").isin(*clashing), F.col("cls").bitwiseXOR(F.col("other"))).otherwise(F.col("cls")))
        classes, again = _classes(sets)
        if again:
            raise ValueError("fingerprints of sets are not spread: combined halves have names in common")
    rooted = classes.select("cls", "first").join(_linked(docs, classes, heat, crowded, clashing).withColumnRenamed("node", "cls"), "cls")
    joined = rooted.select("cls", "component").join(rooted.groupBy("component").agg(F.min("first").alias("joint")), "component").drop("component")
    own = classes.select("cls", "first").join(joined, "cls", "left").select("cls", F.coalesce("joint", "first").alias("first"))
    return sets.join(own, "cls", "left").select("doc_id", "key", "more", "n", "cls", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "first")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    return _grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns: of each group one, that of smallest id (null ids last; of equal ids any one text).

    Rows without shingles stay. Rows that repeat an id are told apart by their texts; of equal rows one stays.
    """
    rows = stage_table(_grouped(docs).where("cls IS NOT NULL").select("doc_id", "key", "more", "first"), "grouped")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("more") == F.col("first.more"))
    own = docs["doc_id"].cast("long"), docs["text"].cast("string")
    is_row = lambda name: (_key(*own) == F.col(f"{name}_key")) & (_more(*own) == F.col(f"{name}_more"))
    gone = checked_broadcast(rows.where(~stays).select(F.col("key").alias("__gone_key"), F.col("more").alias("__gone_more")).distinct(), FETCHED)
    kept = docs.join(gone, is_row("__gone"), "left_anti")
    again = rows.where(stays).groupBy(F.col("key").alias("__again_key"), F.col("more").alias("__again_more")).count().where("count > 1").drop("count")
    again = stage_table(again, "again")
    if again.isEmpty():
        return kept
    alone = kept.join(again, is_row("__again"), "left_anti")
    same = kept.join(again, is_row("__again")).groupBy("__again_key", "__again_more").agg(F.any_value(F.struct(*(kept[c] for c in docs.columns))).alias("__row"))
    return alone.unionByName(same.select("__row.*"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY ALL"""
