"""Backgrounds that arrive as files: each new batch is run once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_stream(spark: SparkSession, folder: str, checkpoint: str, run: Callable[[DataFrame, int], None], schema: str = "ordinal long, locus long") -> None:
    """Calls run(batch, id) for the Parquet files that came since the last call; the checkpoint keeps what was done."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
