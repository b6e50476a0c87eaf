"""Sharding by extendible hashing: a directory indexed by hash-prefix bits.

A shard is a hash prefix. Whatever holds more bytes than the limit is split on the next bit, and
nothing else is, until every shard fits. Splitting works on sums of bytes by prefix; documents are
read for their length only, and once more to be placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import materialize, texts

#: Bits that a further pass of sums resolves, and bits of the hash.
STEP, BITS = 10, 60


def hash_bits(key: Column) -> Column:
    """The first BITS bits of the key's MD5 as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, BITS // 4), 16, 2), BITS, "0")


def directory(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """shard, shard_bytes, shard_docs: prefixes that cover all documents, none of them over the limit
    but those that no bit can split (one id, or as many equal ids, larger than the limit)."""
    sized = texts(docs).select(hash_bits(F.coalesce("doc_id", F.lit(-1))).alias("h"), F.octet_length("text").cast("long").alias("bytes"))
    total, count = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    spark = docs.sparkSession
    large = spark.createDataFrame([("", total, count)] if count else [], "shard string, shard_bytes long, shard_docs long")
    if total <= limit_bytes:
        return large
    # as many bits as shards of an eighth of the limit need, then STEP more for those that are still too large
    done, depth, end = None, 0, min(BITS, max(1, (total // limit_bytes).bit_length() + 3))
    while depth < BITS and not large.isEmpty():
        cells = sized.groupBy(F.substring("h", 1, end).alias("h")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        if depth:
            cells = cells.join(large.select(F.col("shard").alias("top")), F.substring("h", 1, depth) == F.col("top"), "left_semi")
        depths = F.explode(F.sequence(F.lit(depth + 1), F.lit(end)))
        sums = cells.withColumn("d", depths).groupBy(F.expr("substring(h, 1, d)").alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        sums = materialize(sums, "sums", free=False)
        over = sums.where(F.col("shard_bytes") > limit_bytes)
        # split: all that come from an oversized prefix; the first bit below the old ones comes from one in any case
        parents = over.select(F.col("shard").alias("parent"))
        split = sums.join(parents, F.expr("substring(shard, 1, length(shard) - 1)") == F.col("parent"), "left_semi").unionByName(sums.where(F.length("shard") == depth + 1))
        fit = split.where((F.col("shard_bytes") <= limit_bytes) & (F.length("shard") > 0))
        done = fit if done is None else done.unionByName(fit)
        large, depth, end = over.where(F.length("shard") == end), end, min(BITS, end + STEP)
    return done.unionByName(large)


def shards(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """doc_id, n_bytes, shard (prefix of 0 and 1), depth, shard_bytes of every row.

    Rows with one id share a shard; a null id counts as -1, a null text as empty. An empty table gives
    an empty result. Other columns are not read. The directory has a row for each shard; documents
    join it on the prefix lengths that occur.
    """
    found = materialize(directory(docs, limit_bytes), "directory", free=False).withColumn("depth", F.length("shard"))
    depths = [r["depth"] for r in found.select("depth").distinct().orderBy("depth").collect()]  # BITS + 1 numbers at most
    rows = texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), hash_bits(F.coalesce("doc_id", F.lit(-1))).alias("h"))
    keyed = rows.withColumn("shard", F.explode(F.array(*[F.substring("h", 1, d) for d in depths] or [F.lit("")])))
    return keyed.join(found, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")
