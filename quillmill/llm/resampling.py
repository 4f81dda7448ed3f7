"""Quality classifier by importance resampling.

Two generative models of hashed n-grams: one of target texts (those labelled good and not toxic), one of the raw corpus.  A
document's log weight is the log ratio of its probability under them, where the raw model is counted without the
document itself (in a small corpus it would else speak against itself), and an n-gram counts as its mean in a text of
SPAN n-grams if there are more, so that weights of texts of any length are of a size with the noise.  Adding Gumbel
noise and taking the k greatest sums samples k documents without replacement in proportion to their weights.  k may
be given; else it is the number of documents that are at most ODDS times less likely under the target model than
under the raw one.

n-grams are single tokens and pairs of tokens, tokens are words and runs of punctuation without regard to case.

Scale: two passes over the texts without a shuffle of them; models are vectors of BUCKETS numbers.  The k-th
greatest sum is found by counting in ever finer ranges, not by sorting.  Only the target model uses a sample: at
most MAX_LABELLED labelled documents, those with the least digests of their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import cut, fresh
from quillmill.llm.textbatch import Words, doc_sums, mix, slices

BUCKETS = 1 << 14
#: Bound on the labelled documents that the target model is fitted on.
MAX_LABELLED = 20_000
#: Pseudo-counts in each bucket of both models, in mean counts of the target's buckets, so that what the target texts were too few to show counts little.
SMOOTHING = 10.0
#: n-grams of a text that count in full.
SPAN = 100
ODDS = 20.0
SEED = 20_240

_PAIR = np.uint64(0x9FB21C651E98DF25)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some texts, tokens and pairs in turn, and each text's range among them."""
    words = Words(column, plain=True, punct=True)
    h, n = words.hash, len(words.hash)
    out = np.full(2 * n, BUCKETS, dtype=np.int64)
    if n:
        mask = np.uint64(BUCKETS - 1)
        out[::2] = (h & mask).astype(np.int64)
        out[1:-1:2] = (mix(h[:-1] * _PAIR + h[1:]) & mask).astype(np.int64)
        ends = words.bounds[1:]
        out[2 * ends[ends > 0] - 1] = BUCKETS  # no pair across texts
    return out, 2 * words.bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in slices(batch.column(0)):
            g, bounds = grams(batch.column(0).slice(a, b - a))
            raw += np.bincount(g, minlength=BUCKETS + 1)[:BUCKETS]
            for i in np.flatnonzero(good[a:b]):
                target += np.bincount(g[bounds[i] : bounds[i + 1]], minlength=BUCKETS + 1)[:BUCKETS]
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def models(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality") -> np.ndarray:
    """Counts of each bucket, target and raw in two rows; all zeros if nothing is labelled good.  A label of toxic, where there is one, takes a text out of the target."""
    toxic = F.max(F.coalesce(labels["toxic"], F.lit(0))) if "toxic" in labels.columns else F.lit(0)
    good = (
        labels.where(labels[doc_id].isNotNull()).groupBy(labels[doc_id].alias("good_id")).agg(F.min(labels[quality]).alias("q"), toxic.alias("t")).where("q >= 1 AND t < 1")
        .select("good_id").orderBy(F.xxhash64("good_id"), "good_id").limit(MAX_LABELLED)
    )
    texts = docs.select(docs[text].alias("text"), docs[doc_id].alias("doc_id")).join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left")
    rows = (
        texts.select("text", F.col("good_id").isNotNull().alias("good")).mapInArrow(_count, "bucket int, raw bigint, target bigint")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows.column("bucket").to_numpy()
    raw[at], target[at] = rows.column("raw").to_numpy(), rows.column("target").to_numpy()
    return np.stack([target, raw]) if target.sum() else np.zeros((2, BUCKETS))


def log_weights(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    target, raw = counts
    share = target.sum() / max(1.0, raw.sum())
    extra = max(SMOOTHING * target.sum() / BUCKETS, 1e-9)
    g, bounds = grams(column)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = np.sort((doc * (2 * BUCKETS) + g)[g < BUCKETS])
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    own = np.diff(np.append(at, len(key)))
    b, d = key[at] % (2 * BUCKETS), key[at] // (2 * BUCKETS)
    ratio = np.log((target[b] + extra) / (np.maximum(raw[b] - own, 0) * share + extra))
    at = np.searchsorted(d, np.arange(len(bounds)))
    n = doc_sums(own, at)
    return doc_sums(own * ratio, at) * np.minimum(n, SPAN) / np.maximum(n, 1)


def _weigher(counts):
    @F.arrow_udf(T.DoubleType())
    def weigh(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(log_weights(text.slice(a, b - a), counts.value) for a, b in slices(text))]))

    return weigh


def kth_greatest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th greatest value of a column without nulls, by counting in ever finer ranges."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    while True:
        inside = rows.where(F.col(column).between(low, high))
        step = (high - low) / 4096
        if step > 0 and low + step > low and high - step < high:
            place = F.least(F.lit(4095), F.floor((F.col(column) - low) / step).cast("int"))
            ranges = sorted(inside.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect(), reverse=True)
        else:
            ranges = sorted(((0, r["n"], r[column], r[column]) for r in inside.groupBy(column).agg(F.count("*").alias("n")).collect()), key=lambda r: -r[2])
        for _, n, a, b in ranges:
            if k <= n:
                break
            k -= n
        if a == b:
            return a
        low, high = a, b


def weighted(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key (log weight plus Gumbel noise), keep: one row for each row of docs.

    The noise is seeded by id and text, so that rows alike in both are kept or not kept together; ties at the k-th
    key are all kept.  A null or empty text has log weight 0; very long texts are weighed whole.  A null id stays null.
    Without good labels all weights are 0 and, unless k is given, all documents kept.  An empty table gives an empty
    one.  Other columns aren't read.
    """
    rows = cut(_weights(docs, labels, text, doc_id, seed).select("doc_id", "log_weight", "sample_key"))
    return rows.withColumn("keep", F.col("sample_key") >= F.lit(_threshold(rows, k)))


def _gumbel(docs: DataFrame, text: str, doc_id: str, seed: int):
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs[doc_id], docs[text]), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def _weights(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, seed: int) -> DataFrame:
    counts = docs.sparkSession.sparkContext.broadcast(models(docs, labels, text, doc_id))
    noise = _gumbel(docs, text, doc_id, seed)
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("k"), _weigher(counts)(docs[text]).alias("log_weight"), noise.alias("noise"))
    return rows.select("doc_id", "k", "log_weight", (F.col("log_weight") + F.col("noise")).alias("sample_key"))


def _threshold(rows: DataFrame, k: int | None) -> float:
    """The k-th greatest key: with fewer rows than k, a key below all."""
    if k is None:
        k = rows.where(F.col("log_weight") >= -math.log(ODDS)).count()
    elif k >= rows.count():
        return float("-inf")
    return kth_greatest(rows, "sample_key", k)


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, k: int | None = None) -> DataFrame:
    """The rows of docs that weighted() keeps, with all their columns, whatever their names."""
    rows = cut(_weights(docs, labels, text, doc_id, seed))
    gone_id, gone_k = fresh(docs.columns, "gone_id", "gone_k")
    gone = rows.where(F.col("sample_key") < F.lit(_threshold(rows, k))).select(F.col("doc_id").alias(gone_id), F.col("k").alias(gone_k)).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs[text]) == F.col(gone_k)), "left_anti")
