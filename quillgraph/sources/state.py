"""Cutting the lineage of iterative operators, and folders for streaming state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a local session without one gets its own."""
    kept = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        kept = tempfile.mkdtemp(prefix="quillgraph-")  # one machine: tests and trials
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(kept)
    return kept


def folder(spark: SparkSession, name: str) -> str:
    return f"{base(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: a long chain of joins is neither planned nor computed twice."""
    base(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in that folder: for loops, whose plans would else carry the size estimates of every round before."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
