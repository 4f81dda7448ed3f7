"""Token counts through a digest cache.

The cache is a Parquet folder of (tokenizer, digest, n_tokens): the tokenizer column is a digest of the
vocabulary file and of the way it is applied, digest is the SHA-256 of the normalised text (line ends as line
feeds).  A run joins the documents' digests to the cache, encodes one document of each digest that is missing,
appends those counts and answers everything from the cache.

Scale: only digests and ids are shuffled for the lookups; a text is moved once, and only if its digest is a
miss.  Appending is one Parquet write, whose commit leaves no half-written rows; should two runs append the same
digest, reading takes one.  Each file holds counts of one tokenizer, so that a scan passes over the files of others
by their statistics.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import shared_dir
from quillmill.llm.textbatch import slices

#: The usual split of text into words for byte-level vocabularies of 50k entries.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
NORMALISATION = "line-feeds-1"
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def normalised(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def tokenizer_version(vocabulary: str) -> str:
    """Digest of the vocabulary file, the split pattern and the normalisation: change one, and no stored count is used."""
    h = hashlib.sha256()
    with open(vocabulary, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    h.update(f"\0{PATTERN}\0{NORMALISATION}".encode())
    return h.hexdigest()


_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer, loaded once in each worker."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _counter(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            counts: list[int] = []
            for a, b in slices(batch.column(1)):
                counts += [len(encode(t)) for t in batch.column(1).slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return count


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for this tokenizer version; a cache that doesn't exist yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, cache_path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens: one row for each row of docs.

    A null text has a null count, an empty one 0; very long texts are encoded whole.  Equal texts, repeated rows among them, are encoded once.  A
    null id stays null.  An empty table gives an empty one and leaves the cache as it was.  Other columns aren't
    read.  Strings that look like special tokens are counted as ordinary text.
    """
    spark = docs.sparkSession
    cache_path = cache_path or shared_dir(spark) + "/token-cache"
    version = tokenizer_version(vocabulary)
    digest = F.unhex(F.sha2(normalised(docs[text]), 256))
    keyed = docs.select(docs[doc_id].alias("doc_id"), digest.alias("digest"))
    some = docs.where(docs[text].isNotNull()).select(digest.alias("digest"), docs[doc_id].alias("doc_id"), normalised(docs[text]).alias("text"))

    known = read_cache(spark, cache_path, version)
    missing = (
        some.groupBy("digest").agg(F.min("doc_id").alias("one")).join(known, "digest", "left_anti")
        .select(F.col("digest").alias("missed"), "one").hint("shuffle_hash")
    )
    fresh = (
        some.join(missing, (F.col("digest") == F.col("missed")) & F.col("doc_id").eqNullSafe(F.col("one")))
        .select("digest", "text")
        .mapInArrow(_counter(vocabulary), "digest binary, n_tokens bigint")
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return keyed.join(read_cache(spark, cache_path, version), "digest", "left").select("doc_id", "n_tokens")
