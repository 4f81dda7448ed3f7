"""Incremental ingest with Structured Streaming: an extension, for mailboxes that grow.

Messages arrive as files; each id is taken once, bulk flags and clean bodies are computed on the way, and entities are
appended.  The tables that result are those that the batch operators read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.address import is_bulk_message
from quillmill.functions.text import without_quotes
from quillmill.operators.entities import Recogniser, capitalised_spans, entities
from quillmill.sources.schema import MESSAGE


def message_stream(spark: SparkSession, folder: str, per_trigger: int = 64) -> DataFrame:
    """Parquet files of messages as they appear in a folder."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def cleaned(stream: DataFrame, user_emails=None) -> DataFrame:
    """Messages with bulk flag and clean body."""
    return stream.withColumn("is_bulk", F.coalesce("is_bulk", F.lit(False)) | is_bulk_message(F.col("headers"), F.col("from_addr"), user_emails)).withColumn(
        "body_clean", F.coalesce("body_clean", without_quotes(F.col("body")))
    )


def once(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each id once, as far back as the delay: state older than that is dropped.  Messages without a readable date pass by their ingest time."""
    at = F.coalesce(F.try_to_timestamp("date"), F.current_timestamp())
    return stream.withColumn("event_time", at).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["message_id"])


def counts_by_account(stream: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Messages and bulk messages by account and day of arrival, with late ones up to the delay."""
    at = F.coalesce(F.try_to_timestamp("date"), F.current_timestamp())
    timed = stream.withColumn("event_time", at).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", window), "source_account").agg(F.count("*").alias("n_messages"), F.count_if("is_bulk").alias("n_bulk"))


def ingest(stream: DataFrame, corpus: str, entity_table: str, checkpoint: str, recogniser: Recogniser = capitalised_spans):
    """Starts the query that appends new messages and their entities; a batch that is repeated after a failure overwrites its own part."""
    def batch(rows: DataFrame, number: int) -> None:
        rows.drop("event_time").write.mode("overwrite").parquet(f"{corpus}/batch={number}")
        taken = rows.sparkSession.read.schema(MESSAGE).parquet(f"{corpus}/batch={number}")
        entities(taken, recogniser).write.mode("overwrite").parquet(f"{entity_table}/batch={number}")

    return once(cleaned(stream)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
