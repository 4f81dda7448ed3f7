"""Embedding near-dedup: classes by all pairs, or pairs by cross-polytope hashing.

near_classes loses no link.  Equal vectors are collapsed to one; the others are packed into blocks, and every two
blocks meet once.  A matrix product in single precision decides all pairs that rounding can't turn, the rest is
decided in double precision.  Each two blocks give a row for each vector that has links there: how many, and one of
the vectors that it is connected to.  So what leaves a task grows with vectors, not with pairs.

near_vectors lists pairs and is approximate.  A unit vector is turned by fast random rotations (three times random
signs and a Hadamard transform); the hash is the axis nearest to it, with its sign.  A key is HASHES such hashes; each
vector has keys in TABLES tables, and in each further keys in which one hash is replaced by its next nearest axis
(multiprobe).  Vectors with a key in common are candidates, and pairs of them whose cosine is at least MIN_COSINE are
verified by their vectors.

Scale: for classes, vectors move twice, to collapse and to pack them; blocks are read from the shared folder by the
tasks that compare them.  A task holds two blocks.  The comparisons grow as the square of the distinct vectors.  For
pairs, keys and ids are shuffled to find candidates, each pair of ids once; vectors move only to candidate pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import cut
from quillmill.llm.simhash import components
from quillmill.llm.textbatch import mix

MIN_COSINE = 0.9
TABLES, HASHES, PROBES = 12, 4, 2
SEED = 71
#: Vectors are compared in blocks of about so many bytes, of which there are at most MAX_BLOCKS: more make larger ones.
BLOCK_BYTES, MAX_BLOCKS = 8_000_000, 512
#: Rows and columns of the part of a matrix product that is looked at at once.
TILE = (256, 4096)
#: Bytes of a vector's digest.
DIGEST = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """The rotation of that number: one in three steps, the same in every task."""
    rng = np.random.default_rng((SEED, number, x.shape[1]))
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1.0, 1.0]), x.shape[1]))
    return x


def bucket_keys(x: np.ndarray) -> np.ndarray:
    """int64 keys of unit vectors: TABLES * (1 + HASHES * (PROBES - 1)) for each."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, size - d)))
    out = []
    for table in range(TABLES):
        axes = []
        for i in range(HASHES):
            y = rotated(x, table * HASHES + i)
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : min(PROBES, size)]
            axes.append((near * 2 + (np.take_along_axis(y, near, axis=1) < 0)).astype(np.uint64))
        choices = [[0] * HASHES] + [[p if j == i else 0 for j in range(HASHES)] for i in range(HASHES) for p in range(1, axes[0].shape[1])]
        for choice in choices:
            key = np.full(n, (table << 16) + size, dtype=np.uint64)
            for i, p in enumerate(choice):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + axes[i][:, p])
            out.append(key.view(np.int64))
    return np.stack(out, axis=1)


def vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of lists by length: (row numbers, unit vectors).  Null, empty, zero and not finite vectors are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        x = np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)
        norm = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        out.append((at[ok], x[ok] / norm[ok, None]))
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def keys_of(column: pa.Array) -> pa.Array:
    out: list = [None] * len(column)
    for at, x in vectors(column):
        for i, k in zip(at.tolist(), bucket_keys(x).tolist(), strict=True):
            out[i] = k
    return pa.array(out, pa.list_(pa.int64()))


@F.arrow_udf(T.DoubleType())
def cosine_of(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.full(len(a), np.nan)
    left, right = vectors(a), {x.shape[1]: (at, x) for at, x in vectors(b)}
    for at, x in left:
        if x.shape[1] in right:
            other, y = right[x.shape[1]]
            both, i, j = np.intersect1d(at, other, assume_unique=True, return_indices=True)
            out[both] = (x[i] * y[j]).sum(axis=1)
    return pa.array(out, from_pandas=True)


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """vec_a, vec_b, cosine: pairs of ids, vec_a the less, whose vectors have at least that cosine; each pair once.

    Vectors that are null, empty, zero or not finite, and rows without an id, are in no pair; vectors of different
    lengths never pair.  If an id has several rows, its pairs have their greatest cosine.  An empty table gives an
    empty one.  Only id and vector are read.
    """
    base = rows.select(rows[vec_id].alias("id"), rows[embedding].alias("v")).where("id IS NOT NULL")
    keyed = cut(base.select("id", keys_of("v").alias("keys")))
    found = keyed.select("id", F.explode("keys").alias("key")).distinct()
    pairs = found.alias("x").join(found.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    pairs = pairs.select(F.col("x.id").alias("vec_a"), F.col("y.id").alias("vec_b")).distinct()
    a, b = base.select(F.col("id").alias("vec_a"), F.col("v").alias("a")), base.select(F.col("id").alias("vec_b"), F.col("v").alias("b"))
    scored = pairs.join(a, "vec_a").join(b, "vec_b").select("vec_a", "vec_b", cosine_of("a", "b").alias("cosine"))
    return scored.groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine")).where(F.col("cosine") >= min_cosine)


def _raw(kind: np.dtype) -> Callable:
    @F.arrow_udf(T.BinaryType())
    def raw(column: pa.Array) -> pa.Array:
        """The numbers of each vector that vectors() takes, as bytes; -0.0 is 0.0."""
        out: list = [None] * len(column)
        for at, x in vectors(column):
            d = x.shape[1]
            rows = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d) + kind.type(0)
            for i, row in zip(at.tolist(), rows.view(f"V{d * kind.itemsize}").ravel().tolist(), strict=True):
                out[i] = row
        return pa.array(out, pa.binary())

    return raw


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From k, raw, n of a task's vectors: one block for each length of them.  Its first digest is its name."""
    blocks: dict[int, list[list]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for values, x in zip(blocks.setdefault(len(row[1]), [[], [], []]), row, strict=True):
                values.append(x)
    for size, (k, raw, n) in blocks.items():
        yield pa.RecordBatch.from_pydict({"name": [k[0]], "size": [size], "k": [b"".join(k)], "raw": [b"".join(raw)], "n": [np.array(n, dtype=np.int64).tobytes()]}, schema=pa.schema([("name", pa.binary()), ("size", pa.int32()), ("k", pa.binary()), ("raw", pa.binary()), ("n", pa.binary())]))


def near_pairs(x: np.ndarray, y: np.ndarray, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of unit vectors with at least that cosine, a part at a time; if y is x, those with i < j."""
    d = x.shape[1]
    a, b = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    slack = 4 * (d + 8) * 2.0**-24  # more than single precision can be wrong by
    for top in range(0, len(x), TILE[0]):
        for left in range(top // TILE[1] * TILE[1] if x is y else 0, len(y), TILE[1]):
            s = a[top : top + TILE[0]] @ b[:, left : left + TILE[1]]
            at = np.flatnonzero(s >= min_cosine - slack)
            if not len(at):
                continue
            i, j = np.divmod(at, s.shape[1])
            ok = s.ravel()[at] >= min_cosine + slack
            i, j = i + top, j + left
            if x is y:
                i, j, ok = i[i < j], j[i < j], ok[i < j]
            open_ = np.flatnonzero(~ok)
            for part in np.array_split(open_, 1 + len(open_) * d // 1_000_000):
                ok[part] = (x[i[part]] * y[j[part]]).sum(axis=1) >= min_cosine
            if ok.any():
                yield i[ok], j[ok]


def join_sets(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j.  parent names for each number the least of its set, before and after."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _linker(kind: np.dtype, min_cosine: float) -> Callable:
    def unit(raw: bytes, size: int) -> np.ndarray:
        x = np.frombuffer(raw, dtype=kind).reshape(-1, size // kind.itemsize).astype(np.float64)
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From two blocks: k, root, links of each vector with links between them; equal roots are connected."""
        for batch in batches:
            for at in range(len(batch)):
                size, name, k, raw, n, name2, k2, raw2, n2 = (c[at].as_py() for c in batch.columns)
                x = unit(raw, size)
                same, m = name == name2, len(x)
                y, first = (x, 0) if same else (unit(raw2, size), m)
                ks, weights = (k, n) if same else (k + k2, n + n2)
                weights = np.frombuffer(weights, dtype=np.int64)
                links, parent = np.zeros(len(weights), dtype=np.int64), np.arange(len(weights))
                for i, j in near_pairs(x, y, min_cosine):
                    j = j + first
                    for p, q in ((i, j), (j, i)):
                        links += np.bincount(p, weights=weights[q], minlength=len(links)).astype(np.int64)
                    join_sets(parent, i, j)
                has = np.flatnonzero(links)
                if len(has):
                    names = np.frombuffer(ks, dtype=f"V{DIGEST}")
                    yield pa.RecordBatch.from_arrays([pa.array(names[has].tolist(), pa.binary()), pa.array(names[parent[has]].tolist(), pa.binary()), pa.array(links[has])], names=["k", "root", "links"])

    return link


def near_classes(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """vec_id, class_id, links: for each document its class and the number of other documents within that cosine of it.

    Classes are what such links connect; a class is named by its least id.  Rows alike in id and vector are one
    document; an id with several vectors is as many documents.  Vectors that are null, empty, zero or not finite have
    no links, and are a class by themselves; if an id has several of them, they are one document.  Rows without an id
    are left out.  Vectors of different lengths are never linked.  An empty table gives an empty one.  Only id and
    vector are read.
    """
    spark = rows.sparkSession
    single = isinstance(rows.schema[embedding].dataType.elementType, T.FloatType)
    kind = np.dtype(np.float32 if single else np.float64)
    base = rows.select(rows[vec_id].alias("id"), rows[embedding].alias("v") if single else rows[embedding].cast("array<double>").alias("v")).where("id IS NOT NULL")
    docs = base.select("id", _raw(kind)("v").alias("raw")).select("id", F.unhex(F.sha2("raw", 256)).alias("k"), "raw")
    named = cut(docs.select("id", "k", F.length("raw").alias("size")).distinct())
    sizes = cut(named.where("k IS NOT NULL").groupBy("k", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n_blocks = min(MAX_BLOCKS, max(math.ceil(total / BLOCK_BYTES), math.ceil(2 * math.sqrt(spark.sparkContext.defaultParallelism))))
    once = docs.where("k IS NOT NULL").groupBy("k").agg(F.first("raw").alias("raw")).join(sizes, "k")
    blocks = cut(once.select("k", "raw", "n").repartition(n_blocks, "k").mapInArrow(_packed, "name binary, size int, k binary, raw binary, n binary"))
    other = blocks.select(*(F.col(c).alias(c + "2") for c in blocks.columns)).hint("shuffle_replicate_nl")  # no broadcast, and no join by length: that could be one task
    met = blocks.join(other, (F.col("size") == F.col("size2")) & (F.col("name") <= F.col("name2")))
    found = cut(met.select("size", "name", "k", "raw", "n", "name2", "k2", "raw2", "n2").mapInArrow(_linker(kind, min_cosine), "k binary, root binary, links bigint"))
    roots = components(found.where("k != root").select(F.col("k").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    vectors_ = sizes.join(links, "k", "left").join(roots.select(F.col("node").alias("k"), "root"), "k", "left")
    vectors_ = vectors_.select("k", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "k").alias("root"))
    classes = vectors_.groupBy("root").agg(F.min("first").alias("class_id"))
    out = named.join(vectors_.join(classes, "root").select("k", "class_id", "links"), "k", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


ORACLE_SQL = f"""
WITH RECURSIVE u AS (SELECT DISTINCT vec_id, CASE WHEN len(v) > 0 AND isfinite(list_dot_product(v, v)) AND list_dot_product(v, v) > 0 THEN v END AS v
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL)),
e AS MATERIALIZED (SELECT *, row_number() OVER () AS n FROM u),
p AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM e a JOIN e b ON a.n <> b.n AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {MIN_COSINE}),
r AS (SELECT n, n AS m FROM e UNION SELECT r.n, p.b FROM r JOIN p ON p.a = r.m)
SELECT min(e.vec_id) AS vec_id, min(o.vec_id) AS class_id, (SELECT count(*) FROM p WHERE p.a = r.n) AS links
FROM r JOIN e ON e.n = r.n JOIN e o ON o.n = r.m GROUP BY r.n
"""
