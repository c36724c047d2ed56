from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "byte_bpe"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        docs = out.cache()
        seen[name] = docs.count()
    assert seen["near_duplicates"] <= seen["toxicity"] and seen["secrets"] == seen["near_duplicates"] and seen["byte_bpe"] == seen["mixing"]
    assert docs.where(F.length("ids_sha256") != 64).isEmpty()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
