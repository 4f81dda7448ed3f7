"""Tables made of texts don't pass through the driver."""

from pyspark.sql import functions as F

from quillmill import catalog
from quillmill.operators import candidates
from quillmill.sources.schema import with_message_columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_person_messages_broadcasts_nothing(spark):
    m = with_message_columns(spark.createDataFrame([("m1", "Ann Berg <ann@gmail.com>", "Hi Ann Berg"), ("m2", "", "ann berg, bo")], "message_id string, from_addr string, body string"))
    found = spark.createDataFrame([("m2", "Ann Berg"), (None, "Bo")], "message_id string, label string")
    met = candidates.person_messages(m, found)
    assert "Broadcast" not in plan(met)
    got = {(r["label"], r["message_id"]): (r["extracted"], r["in_header"], r["in_body"], r["personal"]) for r in met.collect()}
    assert got == {("Ann Berg", "m1"): (False, True, True, True), ("Ann Berg", "m2"): (True, False, True, False), ("Bo", "m2"): (False, False, True, False), ("Bo", None): (True, False, False, False)}


def test_catalogue_and_ranking_broadcast_no_table_of_messages(spark, tmp_path):
    assert "Broadcast" not in plan(catalog.queries()["person_messages"](spark, "/root/testdata/sf0.001"))
    m = with_message_columns(spark.createDataFrame([("m1", "Ann Berg <ann@gmail.com>", "Hi Ann Berg")], "message_id string, from_addr string, body string"))
    found = spark.createDataFrame([("m1", "person", "Ann Berg")], "message_id string, kind string, label string")
    best = candidates.ranked(m, found, found.select("kind", "label", F.col("label").alias("canonical")), ["me@example.com"])
    assert "Broadcast" not in plan(best) and [r["label"] for r in best.collect()] == ["Ann Berg"]
