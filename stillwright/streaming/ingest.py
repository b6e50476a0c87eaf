"""Structured Streaming: files as they arrive, each handled once; late events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwright.functions.text import stem, suffix


def arriving_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """stem, suffix, bytes, modified of new files; the checkpoint's log keeps any from being taken twice."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(path)
    return raw.select(stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("suffix"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def windowed_tally(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and window; a window is final once the watermark has passed its end."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("begin"), key, "n")


def appended(df: DataFrame, path: str, checkpoint: str):
    """Start writing a stream to Parquet; everything available is processed, then it ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
