"""The corpus pipeline: each stage works on all that its predecessor kept.

Quality classifier (rejected documents go), n-gram Jaccard join (one row of each class stays),
benchmark decontamination (documents that hold an item go), pseudonyms in the texts, packing.

Stages decide on rows by their texts, so rows that repeat an id or have none are treated like all others.
Null texts count as empty ones, extra columns of any name are dropped, an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwright.llm.common import BROADCAST_HASHES, discard, materialize, table, text_hash, without_texts
from stillwright.llm.decontamination import contaminated_texts
from stillwright.llm.jaccard_join import near_duplicates
from stillwright.llm.packing import pack
from stillwright.llm.pii import pseudonymise
from stillwright.llm.quality import quality_scores
from stillwright.llm.registry import KEY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose texts the classifier predicts to be of low quality. Empty and null texts are scored like
    any other; equal texts have equal scores, so repeated rows stay or go together. Without labels all stay."""
    docs = docs.select(*COLUMNS)
    return without_texts(docs, quality_scores(docs, table(spark, sf_dir, "labels"), threshold=0.3).where("predicted = 0"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least id stays (rows without an id come last; of
    texts that share an id, and of rows without one, the least text_hash), and once if it is repeated.
    Texts without words, empty and null ones, are one class."""
    docs = docs.select(*COLUMNS)
    found = materialize(near_duplicates(docs, shingle=5, threshold=0.8).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "first"), "classes")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (text_hash(docs["text"]) == F.col("_hash"))
    gone = found.where("not first").select("_id", "_hash").distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_HASHES else gone, same, "left_anti")
    twice = found.where("first").groupBy("_id", "_hash").count().where("count > 1").select("_id", "_hash")
    n = twice.count()
    if not n:
        return kept
    twice = F.broadcast(twice) if n <= BROADCAST_HASHES else twice
    once = kept.join(twice, same, "left_semi").withColumn("_hash", text_hash(F.col("text"))).dropDuplicates(["doc_id", "_hash"]).drop("_hash")
    return kept.join(twice, same, "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose texts hold a benchmark item. Null and empty texts hold none; repeated rows stay or go together."""
    docs = docs.select(*COLUMNS)
    return without_texts(docs, contaminated_texts(docs, table(spark, sf_dir, "benchmark")))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates in the texts become pseudonyms; null texts become empty, n_chars that of the
    new text. Every row stays, and equal texts stay equal."""
    return pseudonymise(docs, KEY, keep=("lang", "source")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens, of every row for itself; empty texts are the end id alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pseudonyms", pseudonyms), ("packing", packing)]
#: The stages fit models and hash texts, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before has written, which is deleted when the next has been written:
    the result of the last one for sf_dir's documents."""
    docs, written = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
            if written is not None:
                discard(written)
            written = docs
    return docs
