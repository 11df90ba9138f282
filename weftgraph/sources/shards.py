"""Sharded PPR tables: partitioned by their parameters, read with partition pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("dataset", "split", "alpha", "eps", "topk", "norm")


def offsets(shards: DataFrame) -> DataFrame:
    """shards(shard, rows) with `front`, the rows of all shards before."""
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("front", F.coalesce(F.sum("rows").over(upto), F.lit(0)))


def write_ppr(scores: DataFrame, path: str, **keys) -> None:
    """Appends scores(src, dst, weight) under one partition of KEYS; rows keep explicit src ids."""
    out = scores.select("src", "dst", "weight", *[F.lit(str(keys.get(k, ""))).alias(k) for k in KEYS])
    out.write.mode("append").partitionBy(*KEYS).parquet(path)


def read_ppr(spark: SparkSession, path: str, **keys) -> DataFrame:
    """Scores of one partition; only its files are read."""
    found = spark.read.option("basePath", path).schema("src long, dst long, weight double, " + ", ".join(f"{k} string" for k in KEYS)).parquet(path)
    for k, v in keys.items():
        found = found.filter(F.col(k) == str(v))
    return found.select("src", "dst", "weight")


def complete_ppr(stored: DataFrame, seeds: DataFrame, compute) -> DataFrame:
    """Read-through: stored rows of the seeds, and compute(missing seeds) for the rest."""
    from ..operators.ppr import missing_rows

    have = stored.join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    return have.unionByName(compute(missing_rows(seeds, stored)))
