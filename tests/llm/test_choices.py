"""Rules that hold for all rows alike, whatever else the table holds, and parameters that change what is kept."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, documents, prose

import corpus_pipeline
from quillmill.llm import common, license_scan, packing, piece_sampling, recompression, repetition, resampling, resharding, simhash, token_cache

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.mark.parametrize("more", [[], [(3, "some words"), (3, "some words")]])
def test_repeated_rows_without_words(spark, more):
    rows = [(1, None), (1, None), (2, ""), (2, ""), (4, "one two"), *more]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert collections.Counter(r["doc_id"] for r in simhash.simhash_dedup(docs).collect()) == dict.fromkeys([1, 2, 4, *(i for i, _ in more)], 1)


def test_a_text_twice_is_rejected(spark):
    rnd = random.Random(3)
    once = prose(rnd, 200)
    docs = documents(spark, [once, f"{once}\n{once}", f"{once} {once}", prose(rnd, 200) + " " + once])
    assert [r["doc_id"] for r in repetition.repetition_filter(docs).collect()] == [0, 3]


def gumbel_keep(rows, k):
    key = sorted((r["sample_key"] for r in rows), reverse=True)
    return {r["doc_id"] for r in rows if r["sample_key"] >= key[k - 1]}


def test_sample_of_k(spark):
    rnd = random.Random(31)
    texts = [prose(rnd, rnd.choice([5, 60, 400])) if i % 3 else " ".join(w + "$$$" for w in prose(rnd, 60).split()) for i in range(150)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 150, 2)], LABELS)
    col, counts = pa.array(texts), resampling.models(docs, labels)
    rows = resampling.weighted(docs, labels, k=20).collect()
    weight = dict(enumerate(resampling.log_weights(col, counts).tolist()))
    assert all(r["log_weight"] == pytest.approx(weight[r["doc_id"]], abs=1e-9) for r in rows) and all(abs(w) < 25 * resampling.SPAN / 10 for w in weight.values())
    noise = [r["sample_key"] - r["log_weight"] for r in rows]
    assert len(set(noise)) == 150 and abs(np.mean(noise) - 0.577) < 0.4
    assert {r["doc_id"] for r in rows if r["keep"]} == gumbel_keep(rows, 20) == {r["doc_id"] for r in resampling.resample(docs, labels, k=20).collect()}
    auto = resampling.weighted(docs, labels).collect()
    k = sum(r["log_weight"] >= -math.log(resampling.ODDS) for r in auto)
    assert {r["doc_id"] for r in auto if r["keep"]} == gumbel_keep(auto, k) and 95 <= k <= 100
    assert resampling.resample(docs, labels, k=1000).count() == 150 and resampling.resample(docs, labels, k=0).count() == 0


def test_smoothing_follows_the_target(spark):
    texts = [f"{a} {b}" for a in "abcd" for b in "efg"]
    counts = np.stack([resampling.models(documents(spark, texts), spark.createDataFrame([(i, 1, 0) for i in range(6)], LABELS))])[0]
    once, tenfold = (resampling.log_weights(pa.array(["q r s"]), counts * n) for n in (1, 10))
    assert once.tolist() == pytest.approx(tenfold.tolist())


def test_two_thousand_removed_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text of {i} " * (1 + i % 3), "en", f"old{i % 2000}", 1) for i in range(4000)], DOCS)
    sizes = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(F.octet_length("text"))).collect()}
    total = sum(sizes.values())
    layout = resharding.reshard(docs, F.col("source"), {f"new{i}": total // 3 for i in range(4)}, f"file://{tmp_path}/out").collect()
    size = collections.Counter()
    for r in layout:
        size[r["new_shard"]] += r["n_bytes"]
    assert len(layout) == 4000 and sum(size.values()) == total and set(size) <= {f"new{i}" for i in range(4)} and max(size.values()) <= total // 3 + 2000 * 60


def test_unbroken_text(spark):
    """A megabyte without white space goes through every operator for texts whole."""
    docs = documents(spark, ["q" * 1_000_000, "漢" * 100_000, "a b c"])
    assert [r["n_words"] for r in repetition.repetition_report(docs).orderBy("doc_id").collect()] == [1, 1, 3]
    assert sum(r["n_words"] for r in packing.retrieval_packs(docs).collect()) == 5
    assert recompression.substring_dedup(docs).count() == simhash.simhash_dedup(docs).count() == 3 and license_scan.license_scan(docs).count() == 0
    assert resampling.weighted(docs, spark.createDataFrame([(0, 1, 0)], LABELS)).count() == 3
    counts = {r["doc_id"]: r["n_tokens"] for r in token_cache.token_counts(docs, "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert counts[0] > 10_000 and counts[2] == 3
    rows = piece_sampling.sample_segmentations(docs, "/opt/tokenizers/piece_bpe_32k.model", decode=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) >= 5 and all(r["decoded"] == texts[r["doc_id"]] for r in rows)


def test_stages_on_awkward_rows(spark, tmp_path):
    rnd = random.Random(4)
    same = prose(rnd, 60)
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, same, "en", "a", 1), (5, same, None, None, None), (5, same, None, None, None), (6, prose(rnd, 20_000), "en", "b", 1), (8, "x", "en", "b", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("keep", F.lit("x")).withColumn("k", F.lit(1))
    spark.createDataFrame([(6, 0, 0), (None, 1, 0), (8, None, None)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        left[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) if name != "packing" else out.collect()
    every = sorted(((r[0], r[1]) for r in rows), key=str)
    assert left["quality_rules"] == left["quality_classifier"] == every
    assert left["near_dedup"] == sorted({(r[0], r[1]) for r in rows if r[0] != 5}, key=str)
    # of equal texts the one with the least id keeps the passage, and nothing is left of the others
    assert collections.Counter(i for i, _ in left["substring_dedup"]) == {1: 2, 2: 1, None: 2, 6: 1, 8: 1}
    assert sum(r["n_words"] for r in left["packing"]) == 60 * 3 + 20_000 + 1


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host"

        class _jsc:
            class sc:
                class getCheckpointDir:
                    isDefined = staticmethod(lambda: False)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
