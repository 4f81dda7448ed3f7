"""Name variants joined to one canonical name, and vectors by which they are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.names import words
from quillmill.functions.text import cosine

MIN_COSINE, MIN_LENGTH = 0.85, 3
VECTOR = "key string, kind string, model_id string, dim int, vector array<float>, created_at double"


def variant_pairs(labels: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(kind, a, b): labels of one kind of which one begins with the words of the other and whose vectors are near.

    labels: kind, label, vector.  A shared beginning means a shared first word, so that the pairs are joined by kind
    and first word, not by comparing all with all.
    """
    rows = labels.where(F.length("label") >= MIN_LENGTH).select("kind", "label", "vector", words(F.lower("label")).alias("w")).withColumn("w1", F.try_element_at("w", F.lit(1)))
    a, b = rows.alias("a"), rows.alias("b")
    shorter = F.least(F.size("a.w"), F.size("b.w"))
    prefix = F.slice("a.w", F.lit(1), shorter) == F.slice("b.w", F.lit(1), shorter)
    pairs = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.w1") == F.col("b.w1")) & (F.col("a.label") < F.col("b.label")) & prefix)
    return pairs.where(cosine(F.col("a.vector"), F.col("b.vector")) >= min_cosine).select(F.col("a.kind").alias("kind"), F.col("a.label").alias("a"), F.col("b.label").alias("b"))


def connected(pairs: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """(kind, label, root) of all labels in pairs: root is the least label that pairs lead to.  keep() stores a round."""
    both = keep(pairs.select("kind", F.col("a").alias("label"), F.col("b").alias("next")).union(pairs.select("kind", "b", "a")).distinct())
    roots = keep(both.groupBy("kind", "label").agg(F.least(F.col("label"), F.min("next")).alias("root")))
    while True:
        near = roots.select("kind", F.col("label").alias("next"), F.col("root").alias("near"))
        offer = both.join(near, ["kind", "next"]).groupBy("kind", "label").agg(F.min("near").alias("near"))
        step = roots.join(offer, ["kind", "label"]).select("kind", "label", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        far = roots.select("kind", F.col("label").alias("root"), F.col("root").alias("far"))
        new = keep(step.join(far, ["kind", "root"], "left").select("kind", "label", "old", F.coalesce(F.least("root", "far"), "root").alias("root")))
        roots = new.select("kind", "label", "root")
        if new.where(F.col("old") != F.col("root")).isEmpty():
            return roots


def canonical_map(labels: DataFrame, min_cosine: float = MIN_COSINE, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """(kind, label, canonical) of all labels: the longest of a group, of several the first in order; others are their own."""
    roots = connected(variant_pairs(labels, min_cosine), keep)
    group = Window.partitionBy("kind", "root").orderBy(F.desc(F.length("label")), "label")
    named = roots.withColumn("canonical", F.first("label").over(group)).select("kind", "label", "canonical")
    return labels.select("kind", "label").distinct().join(named, ["kind", "label"], "left").withColumn("canonical", F.coalesce("canonical", "label"))


def identity_map(labels: DataFrame) -> DataFrame:
    return labels.select("kind", "label").distinct().withColumn("canonical", F.col("label"))


def upsert_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The vector table with new rows put in; of rows with one key a new one stays, of several new ones, or several stored ones, the latest."""
    both = stored.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    last = Window.partitionBy("key").orderBy(F.desc("batch"), F.desc("created_at"))
    return both.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "batch")


def get_vectors(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, vector) of the wanted keys that are stored."""
    return stored.join(keys.select("key").distinct(), "key", "left_semi").select("key", "vector")


def vectors_of_kind(stored: DataFrame, kind: str) -> DataFrame:
    return stored.where(F.col("kind") == kind)


def delete_kind(stored: DataFrame, kind: str) -> DataFrame:
    return stored.where(F.col("kind") != kind)


def embed_missing(stored: DataFrame, wanted: DataFrame, embed: Callable[[Column], Column], model_id: str) -> DataFrame:
    """The vector table with vectors for wanted rows (key, kind, text) that it lacks; only those are embedded."""
    missing = wanted.dropDuplicates(["key"]).join(stored.select("key"), "key", "left_anti")
    new = missing.select("key", "kind", F.lit(model_id).alias("model_id"), embed(F.col("text")).alias("vector"))
    return stored.unionByName(new.select("key", "kind", "model_id", F.size("vector").alias("dim"), "vector", F.unix_timestamp().cast("double").alias("created_at")))
