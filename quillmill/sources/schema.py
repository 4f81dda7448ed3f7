"""The message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDAR_PERSON = "struct<name:string,email:string,source:string,event_title:string,strength:double,signal:string,words:array<string>>"
MESSAGE = (
    "message_id string, thread_id string, from_addr string, to_addr string, subject string, date string, body string, body_clean string, "
    f"headers map<string,string>, is_bulk boolean, calendar_persons array<{CALENDAR_PERSON}>, source_account string, source_path string"
)


def all_text() -> Column:
    """What a search looks into."""
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("subject", "from_addr", "to_addr", "body")])


def clean_text() -> Column:
    """The body without quotes where that is known, else the body."""
    return F.coalesce(F.col("body_clean"), F.col("body"), F.lit(""))


def with_message_columns(rows: DataFrame) -> DataFrame:
    """rows with all columns of the message table; those that are missing get their empty value."""
    empty = {"headers": F.create_map().cast("map<string,string>"), "is_bulk": F.lit(False), "calendar_persons": F.array().cast(f"array<{CALENDAR_PERSON}>"), "body_clean": F.lit(None).cast("string")}
    out = []
    for part in rows.sparkSession.createDataFrame([], MESSAGE).schema:
        c = F.col(part.name) if part.name in rows.columns else empty.get(part.name, F.lit(""))
        out.append(c.cast(part.dataType).alias(part.name))
    return rows.select(*out)
