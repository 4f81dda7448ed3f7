"""The corpus: messages by id, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.address import is_bulk_message


def add(corpus: DataFrame, batch: DataFrame) -> DataFrame:
    """The corpus with those messages of a batch whose ids it has not; of several alike in id one is added."""
    return corpus.unionByName(new_messages(corpus, batch))


def new_messages(corpus: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.dropDuplicates(["message_id"]).join(corpus.select("message_id"), "message_id", "left_anti").select(*batch.columns)


def fingerprint(corpus: DataFrame, key: str = "message_id") -> DataFrame:
    """One row: the digest of the sorted distinct ids, each followed by a line feed."""
    ids = F.array_sort(F.collect_set(F.col(key).cast("string")))
    text = F.coalesce(F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit(""))
    return corpus.agg(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("fingerprint"))


def sizes(corpus: DataFrame) -> DataFrame:
    """One row: messages, bulk messages, characters of bodies."""
    return corpus.agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("is_bulk")).alias("n_bulk"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n_chars")
    )


def source_accounts(corpus: DataFrame) -> DataFrame:
    return corpus.where("source_account <> ''").select("source_account").distinct()


def flag_bulk(corpus: DataFrame, user_emails=None) -> DataFrame:
    """Bulk flags computed for messages that came without them."""
    return corpus.withColumn("is_bulk", is_bulk_message(F.col("headers"), F.col("from_addr"), user_emails))


def union_accounts(accounts: dict[str, DataFrame], total: int | None = None) -> DataFrame:
    """Messages of several accounts, tagged with their account; each account gives an equal share of total at most.

    Messages that several accounts have stay in each; the corpus takes one when they are added.
    """
    if not accounts:
        raise ValueError("no accounts")
    share = None if total is None else max(1, total // len(accounts))
    parts = [df.withColumn("source_account", F.lit(name)) if share is None else df.limit(share).withColumn("source_account", F.lit(name)) for name, df in accounts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
