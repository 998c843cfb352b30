"""A corpus pipeline in five stages, each written as Parquet and read again as the next one's documents.

Language ID drops documents whose language is unknown or predicted with a low score, and writes the prediction to
``lang``; quality rules drop those that they reject; of near copies one document stays, that of smallest id; sources are
mixed to their target weights, so that a document is left out, kept, or kept twice; packing gives the pieces' places.

Defined results: a null or empty text has no language and goes at the first stage; rows that repeat an id are judged each
on its own, and of equal ones the third stage keeps one; ties go by id, then by a hash; a null source is a source; null
ids are kept like others; an empty table gives an empty result; other columns pass through all stages but the last, also
where their names are those of the operators' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.llm import best_fit_pack, language_id, ngram_jaccard, quality_rules, source_mix
from meridia.llm._common import bounded_batches, read, stage_table


def _stage(fn):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return fn(docs)

    return run


STAGES = [
    ("language_id", _stage(language_id.keep)),
    ("quality_rules", _stage(quality_rules.keep)),
    ("ngram_jaccard", _stage(ngram_jaccard.keep)),
    ("source_mix", _stage(source_mix.keep)),
    ("best_fit_pack", _stage(best_fit_pack.query)),
]

#: Language machines are trained, which SQL can't state; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
