"""Structured Streaming ingestion of edge deltas; an extension beyond batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.reshape import apply_delta

DELTA = "src long, dst long, op string"


def ingest(spark: SparkSession, deltas: str, edges_path: str, checkpoint: str, once: bool = True):
    """Applies a stream of delta files (src, dst, op add or del) to an edge table, one version a batch.

    A batch that is run again writes the same version, so restarts are idempotent.
    """
    stream = spark.readStream.schema(DELTA).parquet(deltas)

    def apply(batch: DataFrame, number: int) -> None:
        edges = spark.read.parquet(f"{edges_path}/v{number}")
        out = apply_delta(edges, batch.filter("op = 'add'"), batch.filter("op = 'del'"))
        out.write.mode("overwrite").parquet(f"{edges_path}/v{number + 1}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
