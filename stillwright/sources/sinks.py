"""Sinks: caches by partition, manifests of stills, prompt texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwright.functions.text import folded_name
from stillwright.functions.timing import minutes_mark
from stillwright.operators.ranking import checkpointed, shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def write_cache(df: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions that df has; Spark commits a write after it has succeeded."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def changed_sources(inventory: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose size differs from the one a finished scan has recorded, new ones too."""
    old = seen.select("stem", F.col("bytes").alias("_old"))
    return inventory.join(old, "stem", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("bytes"))).drop("_old")


def manifest(picks: DataFrame, role: Column, number: Column, label: Column, sec: Column) -> DataFrame:
    """dest: <role>_<number>[_<folded label>]_<m>m<ss>.jpg of each chosen frame."""
    return picks.withColumn("dest", F.concat(F.concat_ws("_", role, number.cast("string"), F.nullif(folded_name(label), F.lit("")), minutes_mark(sec)), F.lit(".jpg")))


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    df.select(key, text).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a cache holds; an empty table where none has been written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def scan_changed(inventory: DataFrame, scan: Callable[[DataFrame], DataFrame], cache: str, records: str) -> DataFrame:
    """Scan the files that differ from the record of finished scans, write the result to the cache by stem, and
    only then the record (stem, bytes): a scan that fails is done again. The files that were scanned."""
    spark = inventory.sparkSession
    todo = changed_sources(inventory.select("stem", "path", "bytes"), read_cache(spark, records, "bytes bigint, stem string"))
    todo = checkpointed(todo)
    if not todo.isEmpty():
        write_cache(scan(todo), cache, "stem")
        write_cache(todo.select("stem", "bytes"), records, "stem")
    return todo
