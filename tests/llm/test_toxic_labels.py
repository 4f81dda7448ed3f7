"""Texts labelled toxic aren't a target."""

from quillmill.llm import resampling


def test_toxic_is_no_target(spark):
    docs = spark.createDataFrame([(0, "fine words"), (1, "vile words"), (2, "other")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 1, None)], "doc_id bigint, quality int, toxic int")
    alone = spark.createDataFrame([(0, 1), (2, 1)], "doc_id bigint, quality int")
    assert (resampling.models(docs, labels) == resampling.models(docs, alone)).all()
