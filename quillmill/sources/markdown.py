"""Messages from Markdown files with YAML front matter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.sources.schema import with_message_columns

_KEYS = ("message_id", "thread_id", "from", "to", "subject", "date")


def _yaml(text: str) -> dict:
    """The mapping in a front matter; a plain reader of `key: value` lines serves where no YAML library is installed."""
    try:
        import yaml
    except ImportError:
        out = {}
        for line in text.splitlines():
            key, colon, value = line.partition(":")
            value = value.strip()
            if colon and not key.startswith((" ", "#", "-")):
                if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                    value = value[1:-1]
                elif len(value) == 20 and value[10:11] == "T" and value.endswith("Z"):
                    value = f"{value[:10]} {value[11:19]}+00:00"
                out[key.strip()] = value
        return out
    found = yaml.safe_load(text)
    return found if isinstance(found, dict) else {}


@F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in _KEYS]))
def front_matter(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        found = _yaml(t or "")
        rows.append([None if found.get(k) is None else str(found[k]) for k in _KEYS])
    return pd.DataFrame(rows, columns=list(_KEYS), dtype="object")


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The messages in a folder's *.md files.

    A file without front matter is an error, which names it.  Ids that are missing are the file's name, thread ids
    the message's id, other fields are empty.
    """
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value"))
    parts = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*\n?(.*)\z"
    ok = F.col("value").rlike(parts)
    text = F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no front matter in "), F.col("source_path"))))
    rows = files.select("source_path", front_matter(F.regexp_extract(text, parts, 1)).alias("f"), F.regexp_extract(text, parts, 2).alias("body"))
    stem = F.regexp_extract("source_path", r"([^/]*)\.md$", 1)
    message_id = F.coalesce("f.message_id", stem)
    return with_message_columns(
        rows.select(
            message_id.alias("message_id"),
            F.coalesce("f.thread_id", message_id).alias("thread_id"),
            *[F.coalesce(F.col("f")[k], F.lit("")).alias(n) for k, n in (("from", "from_addr"), ("to", "to_addr"), ("subject", "subject"), ("date", "date"))],
            F.regexp_replace("body", r"\A\s+", "").alias("body"),
            "source_path",
        )
    )
