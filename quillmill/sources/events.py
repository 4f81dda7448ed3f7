"""Calendar events from a paged service.

A service has ``list_page(calendar, time_min, size, token)``, which gives a page of events as dicts and the token of
the next page or None, or an HttpFailure.  Recurring events come as their single occurrences, in the order of their
beginnings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmill.sources.remote import LIST_UNITS, Metrics, call

CALENDAR, DAYS, MOST, PAGE = "primary", 365, 1000, 250
ATTENDEES = "array<struct<email:string,displayName:string,self:boolean,resource:boolean,organizer:boolean>>"


def list_events(service, metrics: Metrics, days: int = DAYS, limit: int = MOST, now: datetime | None = None, calendar: str = CALENDAR) -> list[dict]:
    """The events of a calendar's last days, up to limit; metrics.truncated says whether there were more."""
    since = ((now or datetime.now(UTC)) - timedelta(days=days)).isoformat()
    out: list[dict] = []
    token = None
    while len(out) < limit:
        page, token = call(lambda: service.list_page(calendar, since, min(PAGE, limit - len(out)), token), metrics, LIST_UNITS)
        out += page
        if not token:
            break
    metrics.truncated = bool(token) or len(out) > limit
    return out[:limit]


class EventSource(DataSource):
    """spark.dataSource.register(...) of a subclass whose service() gives a service; options: days, limit, calendar."""

    @classmethod
    def name(cls) -> str:
        return "quillmill_events"

    def schema(self) -> str:
        return "seq bigint, json string, truncated boolean"

    def service(self):
        raise NotImplementedError("a subclass gives the service")

    def reader(self, schema) -> DataSourceReader:
        return EventReader(self.service(), int(self.options.get("days", DAYS)), int(self.options.get("limit", MOST)), self.options.get("calendar", CALENDAR))


class EventReader(DataSourceReader):
    """One task follows the pages, as each names the next; an error that no retry helps ends the read."""

    def __init__(self, service, days: int, limit: int, calendar: str):
        self.events, self.days, self.limit, self.calendar = service, days, limit, calendar

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        metrics = Metrics()
        for i, e in enumerate(list_events(self.events, metrics, self.days, self.limit, calendar=self.calendar)):
            yield i, json.dumps(e), metrics.truncated


def events(raw: DataFrame, json_column: str = "json", seq: Column | None = None) -> DataFrame:
    """event_id, summary, attendees, as event_persons takes them, from a column of JSON events and their order."""
    e = raw.select((F.col("seq") if seq is None else seq).alias("event_id"), F.from_json(json_column, f"summary string, attendees {ATTENDEES}").alias("e"))
    return e.select("event_id", "e.summary", F.coalesce("e.attendees", F.array().cast(ATTENDEES)).alias("attendees"))
