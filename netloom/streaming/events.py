"""Event windows, the same for a batch and a stream, and their incremental sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _windowed(events: DataFrame, window) -> DataFrame:
    w = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def tumbling(events: DataFrame, size: str) -> DataFrame:
    return _windowed(events, F.window("ts", size))


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return _windowed(events, F.window("ts", size, step))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events with less than `gap` between neighbours."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read(spark, folder: str, schema) -> DataFrame:
    """Events as a stream over a folder of Parquet files, late ones dropped after ten minutes."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("ts", "10 minutes")


def start(windows: DataFrame, sink: str, checkpoint: str):
    """Appends finished windows as Parquet; what is in the folder and the checkpoint survives a restart."""
    return windows.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
