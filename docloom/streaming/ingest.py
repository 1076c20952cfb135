"""Streaming ingest of text files: an extension, there is nothing like it to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(source_uri, text, created_at) of files as they appear, whole texts."""
    lines = spark.readStream.text(folder, wholetext=True)
    return lines.select(F.col("_metadata.file_path").alias("source_uri"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("created_at"))


def ingest_stream(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append items, the first of each source_uri within a day of its time; state older than that is let go."""
    items = stream.withWatermark("created_at", "1 day").dropDuplicatesWithinWatermark(["source_uri"]).withColumn("sha256", F.sha2("text", 256))
    return items.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
