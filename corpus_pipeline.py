"""Training-corpus pipeline: documents in, token ids out.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``:

1. quality rules: documents that a rule rejects go;
2. SimHash near-dedup: one document of each group stays;
3. substring dedup: words of windows that occur elsewhere too go from the texts;
4. benchmark decontamination: documents that hold a benchmark item go;
5. byte-level BPE: the rest as token ids, with the text that they decode to.

Null texts count as empty (the first stage rejects them); repeated rows of one
document are copies of each other; extra columns pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, common, decontaminate, quality_rules, simhash, substring_dedup
from ledgerline.sources.tables import table


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", rule_stage),
    ("SimHash near-dedup", near_copy_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: Fingerprints (XXH64) and token ids have no DuckDB SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.pin(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
