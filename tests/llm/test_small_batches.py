"""Whole texts reach the Python workers, and are hashed there, in small portions."""

import pyarrow as pa

import corpus_pipeline
from wakeline.llm import minhash_dedup

SF = "/root/testdata/sf0.001"


def test_pipeline_hands_few_rows_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get(key)
    try:
        for _, stage in corpus_pipeline.STAGES[2:]:
            spark.conf.set(key, "10000")
            stage(spark, docs, SF)
            assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)


def test_hashing_takes_a_quarter_of_a_megabyte_at_once():
    texts = ["word " * 10_000] * 20
    runs = [raw for _, raw in minhash_dedup.text_runs(pa.array(texts))]
    assert [t.decode() for raw in runs for t in raw] == texts
    assert max(sum(map(len, raw)) for raw in runs) <= 1 << 18
