"""Incremental counts from event streams, as input of the matrix operators (an addition; the engine itself is batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, cell, gene, value): events of each user and type in tumbling windows; later rows than ``late`` are left out of streams."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", length).alias("w"), F.col("user_id").alias("cell"), F.col("event_type").alias("gene")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counted.select(F.col("w.start").alias("window_start"), "cell", "gene", "value")


def fold(totals: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Running totals (cell, gene, value) with a batch of counts added; for ``foreachBatch``."""
    new = batch.select("cell", "gene", "value")
    both = new if totals is None else totals.unionByName(new)
    return both.groupBy("cell", "gene").agg(F.sum("value").alias("value"))
