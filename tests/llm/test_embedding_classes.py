"""op4's classes and links against all pairs, in numpy and by its SQL."""

import math

import duckdb
import numpy as np
import pytest

from quillmill.llm import embedding_dedup, queries


def by_all_pairs(rows):
    """{(id, vector): (class, links)}; rows alike are one document, unusable vectors of an id as well."""
    docs = sorted({(i, tuple(x) if x and np.isfinite(x).all() and any(x) else ()) for i, x in rows if i is not None})
    units = [np.array(x, dtype=np.float64) / np.linalg.norm(x) if x else None for _, x in docs]
    near = [{j for j, y in enumerate(units) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= embedding_dedup.MIN_COSINE} for i, x in enumerate(units)]
    out = []
    for i, (name, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((name, min(docs[j][0] for j in seen), len(near[i])))
    return sorted(out)


def awkward():
    """Many near copies of few vectors, at all distances, a chain, copies, other lengths, and what is no vector."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(150, 64))
    near = np.concatenate([base[rng.integers(6, size=60)] + rng.normal(scale=s, size=(60, 64)) for s in (0.05, 0.2, 0.3, 0.33, 0.4)])
    turn = np.zeros((30, 64))
    turn[:, 0], turn[:, 1] = np.cos(np.arange(30) * 0.3), np.sin(np.arange(30) * 0.3)
    x = np.concatenate([base, near, turn, np.repeat(base[100:101], 20, axis=0)]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    rows += [(5000, None), (5001, []), (5002, [1.0, 0.0]), (5003, [float("nan")] * 64), (5004, [0.0] * 64), (5005, [2.0, 0.0]), (5006, [-0.0, 1.0]), (5007, [0.0, 1.0])]
    return rows + [(None, rows[0][1]), rows[0], (rows[0][0], rows[1][1]), (5000, []), (5008, [float("inf")] * 64)]


@pytest.fixture
def table(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
        return str(tmp_path)

    return write


def run(spark, at):
    return sorted(map(tuple, queries.queries()["op4_embedding_dedup"](spark, at).select("vec_id", "class_id", "links").collect()))


def test_every_document_with_every_link(spark, table, monkeypatch):
    rows = awkward()
    want = by_all_pairs(rows)
    assert sum(n for *_, n in want) > 10_000
    at = table(rows)
    assert run(spark, at) == want
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{at}/embeddings.parquet/*.parquet'")
    result = c.execute(queries.oracle_sql()["op4_embedding_dedup"])
    assert [d[0] for d in result.description] == ["vec_id", "class_id", "links"] and sorted(result.fetchall()) == want
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 9000)  # some 15 blocks, most classes in several
    assert run(spark, at) == want


def test_rows_follow_the_table(spark, table):
    x = np.random.default_rng(3).normal(size=64)
    rows = [(i, (x + 0.001 * i).tolist()) for i in range(400)]
    assert run(spark, table(rows)) == [(i, 0, n) for i, _, n in by_all_pairs(rows)]


def test_tables_without_vectors(spark, table):
    assert run(spark, table([(1, None), (2, []), (None, [1.0])])) == [(1, 1, 0), (2, 2, 0)]
    df = spark.createDataFrame([], "vec_id string, embedding array<double>")
    assert embedding_dedup.near_classes(df).collect() == [] and embedding_dedup.near_classes(df).dtypes == [("vec_id", "string"), ("class_id", "string"), ("links", "bigint")]


def test_bound_is_decided_in_double_precision(spark):
    """Pairs nearer to the bound than single precision tells apart."""
    turns = [math.acos(0.9 + e) for e in (1e-9, -1e-9, 1e-12, -1e-12)]
    rows = [("a", [1.0, 0.0]), *((f"b{i}", [math.cos(t), math.sin(t) * (-1) ** (i // 2)]) for i, t in enumerate(turns))]
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in embedding_dedup.near_classes(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert got == {"a": ("a", 2), "b0": ("a", 2), "b1": ("a", 1), "b2": ("a", 2), "b3": ("a", 1)}


def test_tiles_and_sets(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", (7, 16))
    x = np.random.default_rng(5).normal(size=(90, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for y in (x, x[:50].copy()):
        got = [p for part in embedding_dedup.near_pairs(x, y, 0.9) for p in zip(*(v.tolist() for v in part), strict=True)]
        s = x @ y.T >= 0.9
        assert len(got) == len(set(got)) and set(got) == set(zip(*(v.tolist() for v in np.nonzero(np.triu(s, 1) if y is x else s)), strict=True))
    parent = np.arange(8)
    for i, j in (([5, 6], [6, 7]), ([7, 1], [2, 3]), ([2], [3])):
        embedding_dedup.join_sets(parent, np.array(i), np.array(j))
    assert parent.tolist() == [0, 1, 1, 1, 4, 1, 1, 1]
