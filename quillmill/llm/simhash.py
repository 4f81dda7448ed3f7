"""Near-duplicate documents by SimHash, candidates pruned by pigeonring chains.

A document's features are its distinct plain words, weighted by inverse document frequency over the whole corpus;
its fingerprint has BITS bits, cut into SEGMENTS segments that lie on a ring.  Two documents are near-duplicates
if their fingerprints differ in at most MAX_BITS bits.

Pigeonring: if the ring's differences sum to at most MAX_BITS, then from some segment on every chain of l
consecutive segments differs in at most l * MAX_BITS / SEGMENTS bits.  Candidates that have no such start are
dropped before the full check, which loses no pair.  Candidates come from equal keys, runs of KEY_BITS bits that
begin at every KEY_STEP-th bit, with the PROBE_BITS least certain bits of the run (those whose sums were nearest to
0) set every way.  Only this lookup is approximate: it finds over 0.95 of the pairs that brute force finds.

Scale: fingerprints, not texts, are shuffled.  Documents with one fingerprint are joined as one first, so that
thousands of copies cost no more than one.  Lookup, chains and Hamming check are a shuffled join of narrow rows
in generated code.  What is broadcast is the table of document frequencies, which has one size for any corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import cut, fresh, text_key
from quillmill.llm.stats import bucket, document_frequencies, features
from quillmill.llm.textbatch import mix, slices

BITS, SEGMENTS, MAX_BITS = 128, 16, 24
#: Longest chain that is checked before the full distance.
CHAIN = 6
KEY_BITS, KEY_STEP, PROBE_BITS = 20, 12, 2



def fingerprints(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signed sums for each bit, number of features) of each text; the fingerprint's bits are sums > 0."""
    f, _, bounds = features(column)
    n = len(bounds) - 1
    sums = np.zeros((n, BITS), dtype=np.float32)
    w = weights[bucket(f)]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 40_000, side="right")) - 1)
        a, b = bounds[at], bounds[to]
        x = f[a:b]
        bits = np.unpackbits(np.stack([mix(x + np.uint64(0x9E3779B97F4A7C15)), mix(x ^ np.uint64(0xD1B54A32D192ED03))], axis=1).view(np.uint8), axis=1).astype(np.float32)
        bits -= 0.5
        for i in range(at, to):
            s, e = bounds[i] - a, bounds[i + 1] - a
            if e > s:
                sums[i] = w[bounds[i] : bounds[i + 1]] @ bits[s:e]
        at = to
    return sums, np.diff(bounds)


def keys(sums: np.ndarray) -> np.ndarray:
    """The lookup keys of each fingerprint: the number of the run and its bits, the uncertain ones set every way."""
    bits, out = sums > 0, []
    for c, start in enumerate(range(0, BITS, KEY_STEP)):
        at = (start + np.arange(KEY_BITS)) % BITS
        value = (bits[:, at] @ (1 << np.arange(KEY_BITS))).astype(np.int64) | (c << 40)
        weak = np.argsort(np.abs(sums[:, at]), axis=1, kind="stable")[:, :PROBE_BITS]
        for way in range(1 << PROBE_BITS):
            out.append(value ^ sum(((way >> k) & 1) << weak[:, k] for k in range(PROBE_BITS)))
    return np.stack(out, axis=1)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of fingerprints (rows of two uint64) are near-duplicates: chains first, then all bits."""
    d = np.bitwise_count((a ^ b).view(np.uint8).reshape(len(a), SEGMENTS))
    viable, total = np.ones(d.shape, dtype=bool), np.zeros(d.shape, dtype=np.uint8)
    for length in range(1, CHAIN + 1):
        total += np.roll(d, 1 - length, axis=1)
        viable &= total <= length * MAX_BITS // SEGMENTS
    out = viable.any(axis=1)
    out[out] = d[out].sum(axis=1, dtype=np.int64) <= MAX_BITS
    return out


_TYPE = T.StructType([T.StructField("n", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def _fingerprinter(weights):
    @F.arrow_udf(_TYPE)
    def fingerprint(text: pa.Array) -> pa.Array:
        w = weights.value
        parts, n_features = [np.zeros((0, BITS), dtype=np.float32)], [np.zeros(0, dtype=np.int64)]
        for a, b in slices(text):
            s, n = fingerprints(text.slice(a, b - a), w)
            parts.append(s)
            n_features.append(n)
        sums, n = np.concatenate(parts), np.concatenate(n_features)
        sig = np.packbits(sums > 0, axis=1).view(np.int64).reshape(len(sums), 2)
        k = keys(sums)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * k.shape[1], pa.int32()), pa.array(k.ravel(), pa.int64()))
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(sig[:, 0]), pa.array(sig[:, 1]), lists], names=["n", "hi", "lo", "keys"])

    return fingerprint.asNondeterministic()  # else it would run once for the filter and once for the columns


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From candidate pairs: each fingerprint of a near-duplicate pair with the least that pairs of this task connect it to.

    However many pairs a group has, it leaves the task as one row for each member.
    """
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    for batch in batches:
        for at in range(0, len(batch), 100_000):
            part = batch.slice(at, 100_000)
            x = np.stack([part.column(i).to_numpy() for i in range(4)], axis=1)
            x = x[near(np.ascontiguousarray(x[:, :2]), np.ascontiguousarray(x[:, 2:]))]
            for pair in np.unique(np.ascontiguousarray(x).view("V32")).tolist() if len(x) else ():
                a, b = root(pair[:16]), root(pair[16:])
                if a != b:
                    parent[max(a, b)] = min(a, b)
    nodes = [x for x in list(parent) if root(x) != x]
    if nodes:
        pairs = np.frombuffer(b"".join(x + root(x) for x in nodes), dtype=np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(4)], names=["hi", "lo", "hi2", "lo2"])


def fingerprint_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, k (text key), n (distinct words), hi, lo, keys: written once, one row for each row of docs."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(document_frequencies(docs, text).idf())
    rows = docs.select(docs[doc_id].alias("doc_id"), text_key(docs[text]).alias("k"), _fingerprinter(weights)(docs[text]).alias("f"))
    return cut(rows.select("doc_id", "k", "f.n", "f.hi", "f.lo", "f.keys"))


def candidates(sigs: DataFrame) -> DataFrame:
    """(hi, lo, hi2, lo2): pairs of distinct fingerprints that have a key in common, once for each such key."""
    rows = sigs.select("hi", "lo", F.explode("keys").alias("key"))
    other = rows.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("key").alias("key2"))
    ordered = (F.col("hi") < F.col("hi2")) | ((F.col("hi") == F.col("hi2")) & (F.col("lo") < F.col("lo2")))
    return rows.join(other, (F.col("key") == F.col("key2")) & ordered).select("hi", "lo", "hi2", "lo2")


def links(sigs: DataFrame) -> DataFrame:
    """(a, b): pairs of fingerprints, as structs, that connect the same groups as all near-duplicate pairs do."""
    found = candidates(sigs).mapInArrow(_connect, "hi bigint, lo bigint, hi2 bigint, lo2 bigint").distinct()
    return found.select(F.struct("hi", "lo").alias("a"), F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo")).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the least node that edges lead to.

    Rounds of taking the neighbours' least root, then that root's root; each round is written to the shared folder.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a")).distinct())
    roots = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("root")))
    while True:
        r = roots.select(F.col("node").alias("next"), F.col("root").alias("near"))
        offered = both.join(r, "next").groupBy("node").agg(F.min("near").alias("near"))
        step = roots.join(offered, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(step.join(jump, "root", "left").select("node", "old", F.coalesce(F.least("root", "far"), "root").alias("root")))
        roots = new.select("node", "root")
        if new.where(F.col("root") != F.col("old")).isEmpty():
            return roots


def groups(prints: DataFrame) -> DataFrame:
    """doc_id, k, keeper (struct doc_id, k): for each document of a fingerprint table that has near-duplicates, the one of them with the least id."""
    prints, me = prints.where("n > 0"), F.struct("doc_id", "k")
    sigs = cut(prints.groupBy("hi", "lo").agg(F.min(me).alias("first"), F.min_by("keys", me).alias("keys")))
    roots = components(links(sigs))
    named = sigs.select(F.struct("hi", "lo").alias("node"), "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    keepers = named.groupBy("root").agg(F.min("first").alias("keeper"))
    named = named.join(keepers, "root").select(F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), "keeper")
    return prints.select("doc_id", "k", "hi", "lo").join(named, ["hi", "lo"]).select("doc_id", "k", "keeper")


def simhash_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keeper_id: each document that goes, with the one of its group that stays (the least doc_id).

    Groups are what near-duplicate pairs connect.  Texts that are null, empty or without words are in no group.
    Very long texts are taken whole.  Rows that have both id and text in common are one document, of which nothing is
    said here unless it goes; then it is named once.  A null id counts as the least.  An empty table gives an empty one; no other column is
    read.
    """
    rows = groups(fingerprint_table(docs, text, doc_id))
    return rows.where(F.struct("doc_id", "k") != F.col("keeper")).select("doc_id", "k", F.col("keeper.doc_id").alias("keeper_id")).distinct().drop("k")


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the documents that go, all columns kept; of rows alike in id and text one stays, whatever the text.

    Null and empty texts are in no group, so they go only as such repeats; very long texts are taken whole; an empty
    table stays empty; other columns may have any name.
    """
    prints = fingerprint_table(docs, text, doc_id)
    gone_id, gone_k = fresh(docs.columns, "gone_id", "gone_k")
    gone = groups(prints).where(F.struct("doc_id", "k") != F.col("keeper")).select(F.col("doc_id").alias(gone_id), F.col("k").alias(gone_k)).distinct()
    out = docs.join(gone, docs[doc_id].eqNullSafe(F.col(gone_id)) & (text_key(docs[text]) == F.col(gone_k)), "left_anti")
    if not prints.groupBy("doc_id", "k").count().where("count > 1").isEmpty():
        out = out.withColumn(gone_k, text_key(F.col(text))).dropDuplicates([doc_id, gone_k]).drop(gone_k)
    return out
