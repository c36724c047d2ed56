"""Cuts lineage through a table in the shared checkpoint folder, and deals rows to tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet below spark.checkpoint.dir and reads it back: no lineage, and no constraints that would pile
    up over iterations. A temporary folder is set only in local mode, where one machine does all the work."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leadloom-ckpt-"))
    path = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has. A compressed table may be one file of one row group, which one task
    reads: rules that cost far more than their rows' bytes would then run in that task alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
