"""Training-corpus pipeline over the documents table.

Language ID, exact dedup, near dedup, mixing and packing, each on all that its predecessor
kept. A stage's result is written as Parquet and read again as the next one's documents.

All stages take null and empty texts, null, repeated and tied ids, texts of any length, empty
tables and further columns whatever their names: what each makes of them stands in the
docstring of the operator that it calls. Null and empty texts go in the first stage, as they
have no letter; rows with null ids are judged like others and never merged by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm._common import Scratch
from weftgraph.llm.curriculum import keep_mix
from weftgraph.llm.exact_dedup import keep_exact
from weftgraph.llm.langid import keep_identified
from weftgraph.llm.minhash import keep_near
from weftgraph.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or without text, go; a missing lang is filled in."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space one stays."""
    return keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.75) one stays."""
    return keep_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training position."""
    return keep_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in token-budget batches of optimal length buckets; a bucket's batches follow the training position.

    docs is the mixing stage's table read from its Parquet files, whose order is that of
    the position.
    """
    return pack(docs, in_order=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: Trained predictions and the bucket programme have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    last = None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
