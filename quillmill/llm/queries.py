"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import embedding_dedup, license_scan, packing, piece_sampling, recompression, repetition, resampling, resharding, simhash, token_cache
from quillmill.llm.common import shared_dir, table

TOKENIZERS = "/opt/tokenizers"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeated_passages(table(spark, sf_dir, "documents"))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's ids, and the text that they decode to."""
    return piece_sampling.sample_segmentations(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", decode=True)


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ids divisible by 50 are the queries, against all documents; every word is packed."""
    return packing.retrieval_packs(table(spark, sf_dir, "documents"), every=packing.EVERY)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its class and number of links, by all pairs."""
    return embedding_dedup.near_classes(table(spark, sf_dir, "embeddings"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are counted by a cache to which an earlier run over those with even ids has appended."""
    docs, cache = table(spark, sf_dir, "documents"), shared_dir(spark) + "/token-cache"
    vocabulary = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    token_cache.token_counts(docs.where("doc_id % 2 = 0"), vocabulary, cache)
    return token_cache.token_counts(docs, vocabulary, cache)


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.weighted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of documents are the old shards; there are to be a quarter more, equally large."""
    return resharding.reshard(table(spark, sf_dir, "documents"), F.regexp_extract(F.input_file_name(), "[^/]*$", 0), resharding.grown)


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_report(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": recompression.ORACLE_SQL, "op4_embedding_dedup": embedding_dedup.ORACLE_SQL, "op9_repetition_rules": repetition.ORACLE_SQL, "op10_license_scan": license_scan.oracle(license_scan.TEMPLATES)}
