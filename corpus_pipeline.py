"""A training corpus from `documents`: toxic documents go, of near copies one stays, secrets are redacted, sources are
mixed to their weights, and what is left is encoded. Every stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import bpe, mixing, near_duplicates, secrets, toxicity
from leadloom.llm.common import shared_dir, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", near_duplicates.stage),
    ("secrets", secrets.stage),
    ("mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: SQL has no form of a trained classifier, so the pipeline is tested stage by stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; each one's rows are written as Parquet in the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
