"""The pipeline's stages, each on what the one before kept, against brute force."""

import collections
import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import catalog, common, decontaminate, quality_rules

from ..conftest import SF_SMALL
from .test_dedup import brute_groups, brute_windows
from .test_text_models import encoder


def test_stages_have_their_order_and_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = common.pin(stage(spark, docs, SF_SMALL), "test-stage")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "byte-level BPE"]
    assert all(x.columns == columns for x in seen)
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in seen]
    good = {r.doc_id for r in quality_rules.quality_report(seen[0]).where("kept").collect()}
    assert sorted(i for i, _ in rows[1]) == sorted(good)
    assert sorted(i for i, _ in rows[2]) == sorted({c for _, _, c in brute_groups(rows[1])})
    cut = {i: (lost, digest) for i, _, lost, digest in brute_windows(rows[2])}
    before = dict(rows[2])
    assert collections.Counter(i for i, _ in rows[3]) == collections.Counter(i for i, _ in rows[2])
    for i, t in rows[3]:
        assert (hashlib.sha256(t.encode()).hexdigest() == cut[i][1]) if cut[i][0] else t == before[i]
    hit = {r.doc_id for r in decontaminate.contaminated(seen[3], items).collect()}
    assert sorted(i for i, _ in rows[4]) == sorted(i for i, _ in rows[3] if i not in hit)
    enc = encoder()
    for r in docs.join(seen[4].select(F.col("doc_id").alias("i"), "text"), F.col("i") == F.col("doc_id")).collect():
        assert list(r.tokens) == enc.encode_ordinary(r.text) and r.decoded == r.text
    assert corpus_pipeline.run(spark, SF_SMALL).count() == len(rows[4])


def test_pipeline_takes_awkward_and_empty_tables(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.pin(stage(spark, docs, SF_SMALL), "test-stage")
        docs.collect()


def test_registered_queries():
    names = sorted(catalog.QUERIES)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
