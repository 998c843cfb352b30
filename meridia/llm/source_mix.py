"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

A source's target over its size is the copies that its documents are owed. The whole part is allocated with certainty.
For the fraction p, each document has an inclusion probability of its own, higher for documents that are shorter than
their source's mean, so that the expected words are exactly what is left:

    pi = p + min(p, 1 - p) * (mean x - x),   x = size / (size + mean size) in steps of 1/1024, its mean weighted by size

Documents are ranked by random odds over inclusion odds, u / (1 - u) * (1 - pi) / pi, and those of lowest rank are taken.
The size of the sample is fixed in words: documents are taken in rank order until one does not fit what the target
leaves; then the order is gone through again among the documents that still fit, PASSES times in all. At the end one
more document of the source, the one whose size comes nearest to the words still open, is taken if that brings the
source nearer.

Random numbers are a hash of the document id, so reruns agree. Defined results: a null text has size 0 and is never
taken; a null source is a source of its own, last in order; rows that repeat an id share its random number, and rows
equal in id and size are taken or left together; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm._common import WORD_PATTERN, checked_broadcast, stage_table
from meridia.llm.prefix_cut import position, prefix_cut
from meridia.operators.ordered import running

WEIGHTS = (3, 1, 2)
#: The mix has this share of all words, and no source more than this many times its own.
SHARE, MOST = 1.5, 2
SEED = "mix"
#: How often a source's order is gone through.
PASSES = 3
#: Steps of a document's length against its source's mean.
STEPS = 1024
#: Sources of a broadcast table: at a few hundred bytes each about 60 MB.
SOURCES = 200_000
TIES = ("__mix_id", "__mix_size")


def uniform(identity: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the id: the same in every engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row a source.

    Sources whose share by weight reaches their cap are closed, and what is left is shared anew among the open ones, until
    none is above. A pass is one aggregation over the sources that brings three numbers to the driver.
    """
    ranked = running(sizes, [F.col("source").asc_nulls_last()], "rank")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = stage_table(ranked.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).cast("double").alias("cap")), "weights")
    everything = share * (t.agg(F.sum("source_size").alias("n")).first().n or 0)
    words, open_, closed = 0.0, 1.0, -1
    while True:
        shut = F.col("cap") * F.lit(open_) < F.col("w") * F.lit(words)
        now = t.agg(F.sum(F.when(shut, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(shut, 0.0).otherwise(F.col("w"))).alias("open"), F.count_if(shut).alias("n")).first()
        if now.n == closed or not now.open:
            break
        words, open_, closed = everything - now.held, now.open, now.n
    return t.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(words) / F.lit(open_)).alias("target"))


def _group(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _ranked(rows: DataFrame, aims: DataFrame, seed: str) -> DataFrame:
    """rows (__mix_g, __mix_id, __mix_size, ...) with the columns of aims (__mix_g, p, x_mean, size_mean, ...) and their rank."""
    out = rows.join(checked_broadcast(aims, SOURCES), "__mix_g")
    x = F.floor(F.lit(float(STEPS)) * F.col("__mix_size") / (F.col("__mix_size") + F.col("size_mean")))
    pi = F.col("p") + F.least(F.col("p"), 1 - F.col("p")) * (F.col("x_mean") - x) / F.lit(float(STEPS))
    out = out.withColumn("__mix_u", uniform(F.col("__mix_id"), seed)).withColumn("__mix_pi", pi)
    # the odds ratio q, mapped to q / (1 + q) in [0, 1): the same order, but bounded
    u_odds, p_odds = F.col("__mix_u") * (1 - F.col("__mix_pi")), F.col("__mix_pi") * (1 - F.col("__mix_u"))
    key = F.when(F.col("p") > 0, F.least(u_odds / (u_odds + p_odds), F.lit(1 - 2.0**-52))).otherwise(F.lit(1 - 2.0**-52))
    return out.withColumn("__mix_key", key).withColumn("__mix_at", position("__mix_key", TIES)).drop("__mix_u", "__mix_pi")


def _slim(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.withColumns({"__mix_g": _group(F.col("source")), "__mix_id": F.col("doc_id").cast("long"), "__mix_size": size})


def _taken(passes: int) -> Column:
    """Whether a row with its source's rooms and cuts is taken in one of the first passes."""
    out = F.lit(False)
    for k in range(passes):
        fits = (F.col("__mix_size") > 0) & (F.col("p") > 0) & (F.col("__mix_size") <= F.col(f"room{k}"))
        for earlier in range(k):
            fits &= F.coalesce(F.col("__mix_at") != F.col(f"cut{earlier}"), F.lit(True))
        out |= fits & F.coalesce(F.col("__mix_at") < F.col(f"cut{k}"), F.lit(True))
    return out


def rules(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """All that decides on a document, one row a source: sizes, copies, probabilities, and where each pass ends."""
    slim = stage_table(_slim(docs).select("__mix_g", F.col("source").cast("string").alias("source"), "__mix_id", "__mix_size"), "sizes")
    sizes = slim.groupBy("source").agg(F.sum("__mix_size").alias("source_size"), F.count_if(F.col("__mix_size") > 0).alias("n"))
    sizes = stage_table(sizes, "sources")
    aims = targets(sizes.select("source", "source_size"), weights, share, most).withColumn("__mix_g", _group(F.col("source")))
    aims = aims.join(sizes.select(_group(F.col("source")).alias("__mix_g"), "n"), "__mix_g")
    aims = aims.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    aims = aims.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("p", F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(F.lit(0.0)))
    aims = aims.withColumn("size_mean", F.when(F.col("n") > 0, F.col("source_size") / F.col("n")).otherwise(F.lit(1.0))).withColumn("room0", F.floor("left"))
    aims = stage_table(aims.drop("source"), "aims")
    slim = slim.drop("source")
    x = F.floor(F.lit(float(STEPS)) * F.col("__mix_size") / (F.col("__mix_size") + F.col("size_mean")))
    means = slim.join(checked_broadcast(aims.select("__mix_g", "size_mean"), SOURCES), "__mix_g").groupBy("__mix_g").agg(F.sum(F.col("__mix_size") * x).alias("sum_x"))
    x_mean = F.when(F.col("source_size") > 0, F.col("sum_x") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = stage_table(aims.join(means, "__mix_g").withColumn("x_mean", x_mean).drop("sum_x"), "aims")
    ranked = stage_table(_ranked(slim, aims.select("__mix_g", "p", "x_mean", "size_mean"), seed).select("__mix_g", "__mix_id", "__mix_size", "__mix_key", "__mix_at", "p"), "ranked")
    for k in range(PASSES):
        rows = ranked.join(checked_broadcast(aims.drop("p"), SOURCES), "__mix_g")
        free = ~_taken(k)
        for earlier in range(k):
            free &= F.coalesce(F.col("__mix_at") != F.col(f"cut{earlier}"), F.lit(True))
        fits = rows.where(free & (F.col("__mix_size") > 0) & (F.col("p") > 0) & (F.col("__mix_size") <= F.col(f"room{k}")))
        cuts = prefix_cut(fits.select("__mix_g", "__mix_key", *TIES), aims.select("__mix_g", F.col(f"room{k}").alias("room")), "__mix_g", "__mix_key", "__mix_size", TIES)
        aims = aims.join(cuts.select("__mix_g", F.col("cut_at").alias(f"cut{k}"), F.col("room_left").alias(f"room{k + 1}")), "__mix_g", "left")
        # where all that fitted was taken, no later pass finds any
        aims = stage_table(aims.withColumn(f"room{k + 1}", F.coalesce(f"room{k + 1}", F.lit(0))), "aims")
    rows = ranked.join(checked_broadcast(aims.drop("p"), SOURCES), "__mix_g")
    held = rows.where(_taken(PASSES)).groupBy("__mix_g").agg(F.sum("__mix_size").alias("held"))
    aims = stage_table(aims.join(held, "__mix_g", "left").withColumn("open", F.col("room0") - F.coalesce("held", F.lit(0))).drop("held"), "aims")
    # of the rest, the document whose size is nearest to the words still open, if it brings the source nearer
    rows = ranked.join(checked_broadcast(aims.drop("p"), SOURCES), "__mix_g")
    gap = F.abs(F.col("__mix_size") - F.col("open"))
    last = rows.where((F.col("__mix_size") > 0) & (F.col("p") > 0) & ~_taken(PASSES) & (gap < F.col("open"))).groupBy("__mix_g").agg(F.min(F.struct(gap.alias("gap"), "__mix_at")).getField("__mix_at").alias("last_at"))
    return stage_table(aims.join(last, "__mix_g", "left"), "rules")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of docs."""
    slim = _slim(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")).drop("text")
    rows = _copies(slim, rules(docs, weights, share, most, seed), seed)
    return rows.select("doc_id", "source", F.col("__mix_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__mix_size")).cast("long").alias("taken"))


def _copies(slim: DataFrame, known: DataFrame, seed: str) -> DataFrame:
    """slim rows with their source's rules; ``copies``: how often a row is taken. Each row is judged on its own."""
    rows = _ranked(slim, known.withColumnRenamed("copies", "whole"), seed)
    more = _taken(PASSES) | F.coalesce(F.col("__mix_at") == F.col("last_at"), F.lit(False))
    return rows.withColumn("copies", (F.when(F.col("__mix_size") > 0, F.col("whole")).otherwise(0) + F.when(more, 1).otherwise(0)).cast("int"))


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them (not at all, once or twice)."""
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__mix_row"), "doc_id", "source", "text")
    rows = _copies(_slim(row), rules(docs), SEED).where("copies > 0")
    return rows.select("__mix_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__mix_row.*")


#: A pass: of the rows not yet taken that fit what is open, those whose running sum fits as well; then what is left open.
_PASS_SQL = "\n".join(
    f"""j{i} AS (SELECT *, in{i} OR coalesce(sum(CASE WHEN NOT in{i} AND size <= room{i} THEN size END) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) <= room{i} AND size <= room{i}, false) AS in{i + 1} FROM k{i or ''}),
k{i + 1} AS (SELECT *, room0 - coalesce(sum(CASE WHEN in{i + 1} THEN size END) OVER (PARTITION BY source), 0)::BIGINT AS room{i + 1} FROM j{i}),"""
    for i in range(PASSES)
)
SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [{", ".join(f"{x}.0::DOUBLE" for x in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w, (source_size * {MOST})::DOUBLE AS cap FROM s),
o AS (SELECT *, {SHARE}::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ow,
      sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS owt FROM w),
f AS (SELECT ow AS few, owt AS fewt FROM o WHERE w * ow <= cap * owt ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN few IS NULL THEN cap ELSE least(cap, w * few / fewt) END AS target FROM o LEFT JOIN f ON true),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
p AS (SELECT *, target - copies * source_size AS rest, CASE WHEN source_size > 0 THEN (target - copies * source_size) / source_size ELSE 0 END AS p FROM c),
n AS (SELECT p.*, CASE WHEN c.n > 0 THEN source_size / c.n ELSE 1.0 END AS size_mean FROM p JOIN (SELECT source, count(*) FILTER (size > 0) AS n FROM d GROUP BY source) c ON p.source IS NOT DISTINCT FROM c.source),
x AS (SELECT d.doc_id, d.source, d.size, n.* EXCLUDE (source), floor({float(STEPS)!r}::DOUBLE * d.size / (d.size + size_mean)) AS x FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN sum((size * x)::BIGINT) OVER (PARTITION BY source)::BIGINT / source_size ELSE 0 END AS x_mean FROM x),
u AS (SELECT *, p + least(p, 1 - p) * (x_mean - x) / {float(STEPS)!r}::DOUBLE AS pi, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE AS u FROM y),
k AS (SELECT *, least(u * (1 - pi) / (u * (1 - pi) + pi * (1 - u)), {1 - 2.0**-52!r}::DOUBLE) AS key, floor(rest)::BIGINT AS room0, false AS in0 FROM u WHERE p > 0 AND size > 0),
{_PASS_SQL}
b AS (SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY abs(size - room{PASSES}), key, doc_id, size) AS n FROM k{PASSES} WHERE NOT in{PASSES} AND abs(size - room{PASSES}) < room{PASSES}) WHERE n = 1),
e AS (SELECT doc_id FROM k{PASSES} WHERE in{PASSES} UNION SELECT doc_id FROM b)
SELECT u.doc_id, u.size, u.source_size, u.target, ((copies + CASE WHEN e.doc_id IS NULL THEN 0 ELSE 1 END) * u.size)::BIGINT AS taken FROM u LEFT JOIN e ON u.doc_id = e.doc_id"""
