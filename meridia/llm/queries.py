"""The operators' queries over the driver's tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from meridia.llm import best_fit_pack, chat_format, embedding_dedup, importance_sample, language_id, license_scan, ngram_jaccard, periodic_runs, piece_codec, prefix_trie, quality_rules, source_mix, token_binary
from meridia.llm._common import bounded_batches, read


def _over(table: str, fn):
    def run(spark, sf_dir):
        bounded_batches(spark)
        return fn(read(spark, sf_dir, table))

    return run


def _importance(spark, sf_dir):
    bounded_batches(spark)
    return importance_sample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality_rules": _over("documents", quality_rules.score),
    "op2_language_id": _over("documents", language_id.query),
    "op3_source_mix": _over("documents", source_mix.query),
    "op4_license_scan": _over("documents", license_scan.query),
    "op5_ngram_jaccard": _over("documents", ngram_jaccard.components),
    "op6_embedding_dedup": _over("embeddings", embedding_dedup.query),
    "op7_chat_format": _over("conversations", chat_format.query),
    "op8_best_fit_pack": _over("documents", best_fit_pack.query),
    "op9_token_binary": _over("documents", token_binary.query),
    "op10_importance_sample": _importance,
    "op11_prefix_trie": _over("conversations", prefix_trie.query),
    "op12_piece_codec": _over("documents", piece_codec.query),
    "op13_periodic_runs": _over("documents", periodic_runs.query),
}

ORACLE = {
    "op1_quality_rules": quality_rules.SQL,
    "op3_source_mix": source_mix.SQL,
    "op4_license_scan": license_scan.SQL,
    "op5_ngram_jaccard": ngram_jaccard.SQL,
    "op6_embedding_dedup": embedding_dedup.SQL,
    "op7_chat_format": chat_format.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
}
