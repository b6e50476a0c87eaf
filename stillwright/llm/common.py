"""Shared pieces of the training-data operators: inputs, the shared folder, batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code units of text that one vectorised step works on; a longer single text is a step of its own.
STEP_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; null text is empty.

    Selecting first keeps the scan narrow and extra columns from clashing.
    """
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def text_hash(text: Column) -> Column:
    """What names a text where decisions on texts are carried back to rows, in 128 bits; null is empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


#: Hashes that go to every task at most.
BROADCAST_HASHES = 1_000_000


def without_texts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs but those whose text has a text_hash in gone: whole rows, whatever their id. A few
    hashes (counted) go to every task, so texts move only where there are more."""
    gone = materialize(gone.select("text_hash").distinct(), "gone", free=False)
    few = gone.count() <= BROADCAST_HASHES
    return docs.join(F.broadcast(gone) if few else gone, text_hash(docs["text"]) == gone["text_hash"], "left_anti")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own where none is set and
    all tasks run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _file(spark: SparkSession, path: str):
    """A path and its file system, as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and lost
    executors cost a read instead of a recomputation. The files go with `discard`, at the latest when
    the application ends. A caller that keeps no other reference to df lets its shuffle files go, too
    (free; what shuffles no texts or hashes doesn't need it)."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    at, files = _file(spark, path)
    files.deleteOnExit(at)
    if free:
        gc.collect()
        # Spark's cleaner drops the shuffle files of jobs that nothing refers to any more; the session
        # itself refers to its latest one, hence an empty job before
        spark.range(0).write.format("noop").mode("overwrite").save()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        at, files = _file(df.sparkSession, folder)
        files.delete(at, True)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once a row: the optimizer does not write it out again inside."""
    return F.transform(F.array(value), use)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together have about `most` bytes, so that memory is bounded by them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(sizes).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n)
        yield batch.slice(begin)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
