"""An overlay for each micro-batch of changed paths.

The file source brings JSON lines (path); every micro-batch is joined to the
published map as a batch is. A batch's overlay goes to a folder of its own
number and replaces what an earlier attempt left, so a batch that is run again
leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import overlay
from graphloom.sources import published


def stream_overlays(spark: SparkSession, changes: str, map_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Start the stream; stops by itself when all files present are worked off."""
    def one(batch: DataFrame, number: int) -> None:
        nodes, edges = published.load(spark, map_path)
        overlay.overlay(nodes, edges, batch.select("path")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    read = spark.readStream.schema("path string").json(changes)
    return read.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
