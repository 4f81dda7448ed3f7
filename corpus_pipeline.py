"""The corpus pipeline: documents in, packed training windows out.

Each stage is (name, function) of STAGES; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of documents, whatever
further columns there are and whatever they are called.  Texts are taken whole, however long.  An empty table gives an
empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import packing, recompression, repetition, resampling, simhash
from quillmill.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves go; null and empty texts stay, and repeated rows stay each."""
    return repetition.repetition_filter(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance sample go; null and empty texts weigh 0 and stay.

    Rows alike in id and text stay or go together; ties at the bound stay.  Without good labels all documents stay.
    """
    return resampling.resample(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the least id stays, a null id being the least.

    Null and empty texts are in no group; of rows alike in id and text one stays.
    """
    return simhash.simhash_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier place, by id (null first) and position, are cut.

    A document of which nothing is left goes; null, empty and short texts stay; rows alike in id and text are one
    document, whose rows stay each.
    """
    return recompression.substring_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which words of which document stand in which training window.

    Documents lie beside others of the same head, those with ids divisible by 50 being heads, which all are compared
    with.  Null and empty texts stand in none; repeated rows are packed each; equal scores go by a digest of id and text.
    """
    return packing.retrieval_packs(docs, every=packing.EVERY)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: No SQL: fingerprints, the sample's noise and BM25 with hashed frequencies aren't expressible; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs, out = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{out}/{i}-{name}")
            docs = spark.read.parquet(f"{out}/{i}-{name}")
    return docs
