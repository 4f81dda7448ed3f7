"""Remote mail services: what to do about errors, paging, batches with retries, and a Spark data source over them.

A service is an object with list_page(query, size, token) -> (ids, next token) and get(ids) -> {id: message or
HttpFailure}.  It must be picklable; nothing here talks to a network itself.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_ATTEMPTS, BASE_S, CAP_S, JITTER, LONG = 3, 0.5, 60.0, 0.2, 4
PAGE, BATCH, LIST_UNITS, GET_UNITS = 500, 50, 5, 20

DAILY = {"dailyLimitExceeded", "dailyLimitExceededUnreg", "quotaExceeded"}
USER_BURST = {"userRateLimitExceeded"}
BURST = {"backendError", "rateLimitExceeded"}


@dataclass(frozen=True)
class HttpFailure:
    """A response that isn't a success; body is its JSON."""

    status: int
    body: dict | None = None
    retry_after: str | None = None

    def reasons(self) -> list[str]:
        error = (self.body or {}).get("error")
        found = [e.get("reason") for e in error.get("errors") or [] if isinstance(e, dict)] if isinstance(error, dict) else []
        return [r for r in found if r]

    def oauth_code(self) -> str | None:
        error = (self.body or {}).get("error")
        return error if isinstance(error, str) else None


@dataclass(frozen=True)
class Decision:
    """ok, refresh, backoff, backoff_long, or fatal with a cause; how long to wait; attempts that remain."""

    action: str
    delay: float = 0.0
    remaining: int = 0


def read_failure(status: int, content: bytes | str, retry_after: str | None = None) -> HttpFailure:
    try:
        body = json.loads(content)
    except ValueError:
        body = None
    return HttpFailure(status, body if isinstance(body, dict) else None, retry_after)


def backoff(attempt: int, factor: float = 1.0, rand: Callable[[], float] = random.random) -> float:
    """0.5 s, doubled with each attempt, a minute at most, a fifth more or less."""
    return min(CAP_S, BASE_S * 2 ** max(0, attempt - 1) * factor) * (1 + JITTER * (2 * rand() - 1))


def _wait(failure: HttpFailure) -> float | None:
    try:
        return max(0.0, float(failure.retry_after)) if failure.retry_after is not None else None
    except ValueError:
        return None


def decide(failure: HttpFailure, attempt: int, rand: Callable[[], float] = random.random) -> Decision:
    """What to do after the attempt of that number (from 1)."""
    left, reasons = max(0, MAX_ATTEMPTS - attempt), set(failure.reasons())
    if 200 <= failure.status < 300:
        return Decision("ok", 0.0, left)
    if failure.status == 401:
        if failure.oauth_code() == "invalid_grant" or "invalid_grant" in reasons:
            return Decision("fatal_invalid_grant")
        return Decision("refresh", 0.0, left) if left else Decision("fatal_client")
    if failure.status == 403 and reasons & DAILY:
        return Decision("fatal_quota")
    long = failure.status == 403 and bool(reasons & USER_BURST)
    again = long or failure.status == 429 or 500 <= failure.status < 600 or (failure.status == 403 and bool(reasons & BURST))
    if not again or not left:
        return Decision("fatal_client")
    told = _wait(failure)
    if long:
        return Decision("backoff_long", backoff(attempt, LONG, rand) if told is None else told, left)
    return Decision("backoff", told or backoff(attempt, 1.0, rand), left)


@dataclass
class Metrics:
    """Of one search: quota units, retries, whether more matched, errors."""

    units: int = 0
    retries: int = 0
    truncated: bool = False
    errors: list[str] = field(default_factory=list)

    def error(self) -> str | None:
        """Up to three different errors in one line."""
        return "; ".join(list(dict.fromkeys(self.errors))[:3]) or None


class Fatal(Exception):
    """An error that no retry helps."""


def call(request: Callable[[], object], metrics: Metrics, units: int, refresh: Callable[[], None] = lambda: None, sleep: Callable[[float], None] = time.sleep) -> object:
    """A request's result, repeated as decide() says; quota counts on success."""
    for attempt in range(1, MAX_ATTEMPTS + 1):
        out = request()
        if not isinstance(out, HttpFailure):
            metrics.units += units
            return out
        d = decide(out, attempt)
        if d.action.startswith("fatal"):
            raise Fatal(f"{d.action} ({out.status}{', ' + ', '.join(out.reasons()) if out.reasons() else ''})")
        metrics.retries += 1
        if d.action == "refresh":
            refresh()
        else:
            sleep(d.delay)
    raise Fatal("attempts used up")


def list_ids(service, query: str, limit: int | None, metrics: Metrics) -> list[str]:
    """The ids that match, up to limit if there is one; truncated only if the service had another page."""
    out: list[str] = []
    token = None
    while limit is None or len(out) < limit:
        ids, token = call(lambda: service.list_page(query, PAGE if limit is None else min(PAGE, limit - len(out)), token), metrics, LIST_UNITS)
        out += ids
        if not token:
            break
    metrics.truncated = bool(token)
    return out[:limit]


def get_messages(service, ids: list[str], metrics: Metrics, rounds: int = MAX_ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Messages by id, in batches; up to three rounds, of which the later ask only for what failed."""
    for at in range(0, len(ids), BATCH):
        todo = ids[at : at + BATCH]
        for attempt in range(1, rounds + 1):
            got, failed, wait = service.get(todo), [], 0.0
            for i in todo:
                m = got.get(i)
                if isinstance(m, HttpFailure):
                    d = decide(m, attempt)
                    if d.action.startswith("fatal"):
                        metrics.errors.append(f"{d.action} ({m.status})")
                    else:
                        failed.append(i)
                        wait = max(wait, d.delay)
                elif m is not None:
                    metrics.units += GET_UNITS
                    yield m
            todo = failed
            if not todo:
                break
            metrics.retries += 1
            sleep(wait)


@dataclass
class Found:
    """What a search of a service gives: messages, quota units, retries, whether more matched, errors in one line."""

    query: str
    hits: list[dict]
    units: int = 0
    retries: int = 0
    truncated: bool = False
    error: str | None = None


class Searcher:
    """Searches of one account's service: ids, a message, or both at once."""

    def __init__(self, service, limit: int | None = None, sleep: Callable[[float], None] = time.sleep):
        self.service, self.limit, self.sleep = service, limit, sleep

    def search(self, query: str) -> list[str]:
        return list_ids(self.service, query, self.limit, Metrics())

    def fetch(self, message_id: str) -> dict:
        """A message by id; an error if there is none."""
        metrics = Metrics()
        for m in get_messages(self.service, [message_id], metrics, sleep=self.sleep):
            return m
        raise Fatal(metrics.error() or f"no message {message_id}")

    def search_and_fetch(self, query: str) -> Found:
        """The messages that match; one that can't be had is an error of the result, not of the call."""
        metrics, hits = Metrics(), []
        try:
            hits = list(get_messages(self.service, list_ids(self.service, query, self.limit, metrics), metrics, sleep=self.sleep))
        except Fatal as e:
            metrics.errors.append(str(e))
        return Found(query, hits, metrics.units, metrics.retries, metrics.truncated, metrics.error())


class AccountSearcher:
    """Searches over several accounts, which share the limit equally; what fails in one leaves the others' results."""

    def __init__(self, services: dict[str, object], limit: int | None = None, sleep: Callable[[float], None] = time.sleep):
        share = None if limit is None else max(1, limit // max(1, len(services)))
        self.accounts = {name: Searcher(s, share, sleep) for name, s in services.items()}

    def search(self, query: str) -> list[str]:
        return [i for s in self.accounts.values() for i in s.search(query)]

    def fetch(self, message_id: str) -> dict:
        """From the first account that has it; else the last account's error."""
        error: Exception = Fatal(f"no message {message_id}")
        for s in self.accounts.values():
            try:
                return s.fetch(message_id)
            except Fatal as e:
                error = e
        raise error

    def search_and_fetch(self, query: str) -> Found:
        """Messages with their account (source_account); sums, and errors with the account's name before each."""
        out, errors = Found(query, []), []
        for name, s in self.accounts.items():
            got = s.search_and_fetch(query)
            out.hits += [m | {"source_account": name} for m in got.hits]
            out.units += got.units
            out.retries += got.retries
            out.truncated |= got.truncated
            if got.error:
                errors.append(f"[{name}] {got.error}")
        out.error = "; ".join(errors) or None
        return out


@dataclass
class IdBatch(InputPartition):
    ids: list[str]


class MailSource(DataSource):
    """spark.dataSource.register(...) of a subclass whose service() gives a service; options: query, limit, batch.

    Without a limit all that matches is read.  A message that can't be had is a row with its id and an error.
    """

    @classmethod
    def name(cls) -> str:
        return "quillmill_mail"

    def schema(self) -> str:
        return "id string, threadId string, payload string, error string"

    def service(self):
        raise NotImplementedError("a subclass gives the service")

    def reader(self, schema) -> DataSourceReader:
        return MailReader(self.service(), self.options.get("query", ""), int(self.options["limit"]) if "limit" in self.options else None, int(self.options.get("batch", str(BATCH))))


class MailReader(DataSourceReader):
    """Ids are listed on the driver, where an error ends the read; executors fetch a batch each."""

    def __init__(self, service, query: str, limit: int | None, batch: int):
        self.mails, self.query, self.limit, self.batch = service, query, limit, batch

    def partitions(self) -> list[IdBatch]:
        ids = list_ids(self.mails, self.query, self.limit, Metrics())
        return [IdBatch(ids[i : i + self.batch]) for i in range(0, len(ids), self.batch)] or [IdBatch([])]

    def read(self, partition: IdBatch) -> Iterator[tuple]:
        metrics, left = Metrics(), dict.fromkeys(partition.ids)
        for m in get_messages(self.mails, partition.ids, metrics):
            left.pop(m.get("id"), None)
            yield m.get("id"), m.get("threadId"), json.dumps(m.get("payload") or {}), None
        for i in left:
            yield i, None, None, metrics.error() or "attempts used up"
