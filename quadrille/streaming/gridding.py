"""Gridding of an event stream: counts by hour and day as they arrive.

An addition of this engine; there is no counterpart to keep to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_cells(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window start, x (hour), y (day - 1), v (events), closed by a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", window)).agg(F.count("*").alias("v"))
    return w.select(F.col("window.start").alias("start"), F.hour("window.start").alias("x"), (F.dayofmonth("window.start") - 1).alias("y"), "v")


def write_cells(cells: DataFrame, path: str, checkpoint: str):
    return cells.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
