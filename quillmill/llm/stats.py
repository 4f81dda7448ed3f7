"""Word statistics of a whole corpus in a table of fixed size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.textbatch import Words, give_back, slices

#: Words are counted in 2**DF_BITS buckets by hash; what words of one bucket have in common is a count that is too high.
DF_BITS = 20
#: Words that a task collects before it counts them.
_PENDING = 500_000

_HASH = np.uint64((1 << 48) - 1)


def bucket(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(48 - DF_BITS)).astype(np.int64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes of each text's distinct plain words, how often each occurs, and the texts' ranges among them."""
    words = Words(column, plain=True)
    key = np.sort((words.doc.astype(np.uint64) << np.uint64(48)) | (words.hash >> np.uint64(16)))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    return key & _HASH, tf, np.searchsorted(key, np.arange(words.n_docs + 1, dtype=np.uint64) << np.uint64(48))


@dataclass
class Frequencies:
    """df: for each bucket, how many texts have a word of it; n: texts that have words; total: their words."""

    df: np.ndarray
    n: int
    total: int

    def idf(self) -> np.ndarray:
        return np.log((self.n + 1) / (self.df + 0.5)).clip(0.05).astype(np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n, total = np.zeros(1 << DF_BITS, dtype=np.int64), 0, 0
    parts: list[np.ndarray] = []
    for batch in batches:
        for a, b in slices(batch.column(0)):
            f, tf, bounds = features(batch.column(0).slice(a, b - a))
            parts.append(bucket(f))
            n += int((np.diff(bounds) > 0).sum())
            total += int(tf.sum())
            if sum(map(len, parts)) > _PENDING:
                df += np.bincount(np.concatenate(parts), minlength=1 << DF_BITS)
                parts = []
    if parts:
        df += np.bincount(np.concatenate(parts), minlength=1 << DF_BITS)
    parts = []
    give_back()
    at = np.flatnonzero(df)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]).astype(np.int32)), pa.array(np.append(df[at], [n, total]))], names=["bucket", "df"])


def document_frequencies(docs: DataFrame, text: str = "text") -> Frequencies:
    """Counted over all documents in one pass; what reaches the driver is at most a row for each bucket."""
    rows = docs.select(docs[text].alias("text")).mapInArrow(_count, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    at, count = rows.column("bucket").to_numpy(), rows.column("df").to_numpy()
    df = np.zeros(1 << DF_BITS, dtype=np.float32)
    df[at[at >= 0]] = count[at >= 0]
    return Frequencies(df, int(count[at == -1].sum()), int(count[at == -2].sum()))
