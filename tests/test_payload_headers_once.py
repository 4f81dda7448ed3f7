"""Headers of a payload are read once, however many of them are kept."""

from pyspark.sql import functions as F

from quillmill.sources import payload


def test_header_map_is_computed_once(spark):
    df = spark.createDataFrame([([("SUBJECT", "a"), ("To", "x"), ("X", "y"), ("Subject ", "b"), (" ", "c"), ("Cc", None)],), (None,)], "h array<struct<name:string,value:string>>")
    out = df.select(payload.kept_headers(payload.header_map(F.col("h"))).alias("m"))
    assert [r["m"] for r in out.collect()] == [{"To": "x", "Subject": "b"}, {}]
    plan = out._jdf.queryExecution().optimizedPlan().expressions().mkString()
    assert plan.count("array_contains") == 1
