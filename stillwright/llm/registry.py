"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stillwright.llm import oracles
from stillwright.llm.collocations import collocations
from stillwright.llm.common import table
from stillwright.llm.decontamination import EQUAL, WINDOW, contaminations
from stillwright.llm.fingerprints import fingerprints
from stillwright.llm.hard_negatives import hard_negatives, relabelled
from stillwright.llm.jaccard_join import near_duplicates
from stillwright.llm.main_text import extract_main_text
from stillwright.llm.packing import pack
from stillwright.llm.pii import pseudonymise
from stillwright.llm.quality import quality_scores
from stillwright.llm.sharding import shards
from stillwright.llm.substring_dedup import remove_repeats
from stillwright.llm.token_counts import token_counts
from stillwright.llm.toxicity import toxicity_scores


#: The key of the registered queries; a deployment passes its own secret.
KEY = "registered-query-key"
#: Bytes of text that a shard holds at most.
SHARD_BYTES = 200_000


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), KEY)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3).drop("text_hash")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), limit_bytes=SHARD_BYTES)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=13, block=7)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=5, threshold=0.8).select("doc_id", "class_id", "n_links", "n_copies")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside=50, first=2000)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_packing, op3_quality_classifier, op4_sharding, op5_fingerprints, op6_substring_dedup, op7_decontamination, op8_token_counts, op9_html_extraction, op10_jaccard_join,
        op11_hard_negatives, op12_toxicity, op13_collocations,
    )
}
#: What SQL cannot express (kernels, digests, merges, trees) is tested against plain Python in tests/llm.
ORACLES: dict[str, str] = {
    "op4_sharding": oracles.SHARDING.format(limit=SHARD_BYTES),
    "op6_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op7_decontamination": oracles.decontamination(WINDOW, EQUAL),
    "op10_jaccard_join": oracles.JACCARD_JOIN,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_collocations": oracles.COLLOCATIONS,
}
