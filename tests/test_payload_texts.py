"""Payloads whose texts are long, empty or begin with white space, null ones too."""

import hashlib

from pyspark.sql import functions as F

from quillmill import catalog
from quillmill.sources import payload

ODD = [(0, "", "en"), (1, " \n", "fr"), (2, "\tx ", "de"), (3, " x", " en\t"), (4, None, "en"), (5, "x", None), (6, "x\r", "en")]


def test_bodies_of_odd_documents(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(catalog.queries()["payload_bodies"](spark, str(tmp_path)).collect())
    assert got == {i: None if t is None or lang is None else hashlib.md5(f"{t.strip(' \n')}\n\n{lang}".encode()).hexdigest() for i, t, lang in ODD}


def test_a_body_of_more_than_20_million_characters(spark):
    data = F.base64(F.repeat(F.lit("word "), 3_200_000).cast("binary"))
    tree = F.concat(F.lit('{"parts":[{"mimeType":"text/plain","body":{"data":"'), F.regexp_replace(data, r"\s", ""), F.lit('"}}]}'))
    assert spark.range(1).select(tree.alias("payload")).select(F.length(payload.body("payload"))).first()[0] == 15_999_999
