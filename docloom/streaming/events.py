"""Counts over event streams: the batch reports, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, files_at_once: int = 8) -> DataFrame:
    """The Parquet files of a folder as a stream, with the schema of those there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """event_type, begins, n for each window of time; rows later than ``late`` are left out, so state stays bounded."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = rows.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", F.col("window.start").alias("begins"), "n")


def write_table(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet; what is there is worked off, then the query ends."""
    return counts.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)
