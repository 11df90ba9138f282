"""Cutting lineage in iterative plans with reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpoint_folder(df: DataFrame) -> str:
    """The context's checkpoint folder, set from spark.checkpoint.dir if need be.

    Where that is unset, a local session uses a temporary folder, as in tests; on a cluster,
    whose machines share no such folder, it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Checkpoints df to the shared folder."""
    checkpoint_folder(df)
    return df.checkpoint()


def written(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """df written in folders by columns, under the same shared folder, and read again: a filter on them reads its folders only."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(df)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """The tables of an iteration, written under the shared folder; when a step is written, the one before it, from which it was made, goes."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.base, self.number = f"{checkpoint_folder(df)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def write(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{self.base}/{self.number}"
        df.write.parquet(path)
        if self.number:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{self.number - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        self.number += 1
        return spark.read.schema(df.schema).parquet(path)
