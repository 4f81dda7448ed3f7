"""Decoding is part of the registered query."""

from quillmill.llm import queries


def test_every_sample_decodes_to_its_text(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = queries.op2_sentencepiece_sampling(spark, sf)
    assert rows.count() > 0 and rows.join(texts, "doc_id").where("NOT decoded <=> text").count() == 0
