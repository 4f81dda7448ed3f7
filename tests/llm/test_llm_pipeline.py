"""The pipeline against brute-force versions of its stages, and the registered queries on the small tables."""

import collections
import os
import random
from collections import Counter

import duckdb
import pytest
from test_llm_operators import brute_groups, brute_repeats, brute_repetition, documents, near_copy, prose

import corpus_pipeline
from quillmill.llm import queries as Q
from quillmill.llm import repetition

SF = os.environ.get("QUILLMILL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rnd = random.Random(21)
    passage = prose(rnd, 60)
    good = [prose(rnd, 120) for _ in range(40)]
    good += [f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}" for _ in range(6)]
    copies = [good[0], near_copy(rnd, good[1], 0.02), near_copy(rnd, good[2], 0.03), good[40]]
    bad = ["same words here " * 60, " ".join(w + "$$$" for w in prose(rnd, 80).split())] * 4
    texts = [*good, *copies, *bad]
    folder = str(tmp_path_factory.mktemp("tables"))
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(good) + len(copies)), 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, len(good) + len(copies)


def test_stages(spark, small, tmp_path):
    folder, texts, n_good = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = {k: sorted({r["doc_id"] for r in v}) for k, v in kept.items()}
    ruled = [i for i, t in enumerate(texts) if all(m := brute_repetition(t)) or m["dup5_chars"] * 2 <= m["word_chars"]]
    assert ids["quality_rules"] == [i for i in ruled if brute_repetition(texts[i])["dup5_chars"] * 100 <= repetition.NGRAM_LIMITS[5] * brute_repetition(texts[i])["word_chars"]]
    assert ids["quality_classifier"] == list(range(n_good))
    gone = brute_groups(texts[:n_good])
    assert ids["near_dedup"] == [i for i in range(n_good) if i not in gone] and len(gone) == 4
    left = [texts[i] if i in ids["near_dedup"] else None for i in range(n_good)]
    spans = collections.defaultdict(list)
    for i, a, b, _ in brute_repeats(left):
        spans[i].append((a, b))
    assert len(spans) == 5
    for r in kept["substring_dedup"]:
        assert r["text"].split() == [w for j, w in enumerate(left[r["doc_id"]].split()) if not any(a <= j < b for a, b in spans[r["doc_id"]])]
    packed = Counter()
    for r in kept["packing"]:
        packed[r["doc_id"]] += r["n_words"]
    assert packed == {r["doc_id"]: len(r["text"].split()) for r in kept["substring_dedup"]}


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small[0]).collect()
    assert rows and set(rows[0].asDict()) == {"pack_id", "slot", "doc_id", "start_word", "n_words", "score"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't there")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries(spark, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(map(str, r)) for r in df.select(*cols).collect())
    if name in Q.oracle_sql():
        c = duckdb.connect()
        for t in ("documents", "embeddings"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        result = c.execute(Q.oracle_sql()[name])
        at = [[d[0] for d in result.description].index(x) for x in cols]
        assert rows == Counter(tuple(str(r[i]) for i in at) for r in result.fetchall())
