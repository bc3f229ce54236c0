"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import bpe, conversation_repair, decontaminate, embedding_dedup, hilbert, html_blocks, licences, ordinal_quality, quality_rules, recurrent_lm, simhash, source_divergence, substring_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those in repeated windows, and a digest of the rest."""
    return substring_dedup.repeated_words(table(spark, sf_dir, "documents"))


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot along the Hilbert curve of language, source and size."""
    return hilbert.shard_report(table(spark, sf_dir, "documents"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.main_text(table(spark, sf_dir, "pages"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence paragraph of every document, with its family."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent log10 probability of every document."""
    return recurrent_lm.score(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded bytes of every document, as digests."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                             public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the cascade's verdict for every document."""
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document; the ratings come from the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return ordinal_quality.score(docs, ordinal_quality.train(docs, labels, ordinal_quality.graded(labels), top=2))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with that item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every damaged conversation."""
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and each source's most divergent terms."""
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of every vector."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_hilbert": op2_hilbert,
    "op3_html_blocks": op3_html_blocks,
    "op4_licences": op4_licences,
    "op5_recurrent_lm": op5_recurrent_lm,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_ordinal_quality": op8_ordinal_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_divergence": op12_source_divergence,
    "op13_embedding_dedup": op13_embedding_dedup,
}

#: DuckDB SQL for the same rows; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op7_quality_rules": quality_rules.ORACLE,
    "op12_source_divergence": source_divergence.ORACLE,
}
