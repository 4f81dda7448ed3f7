"""Searchers over accounts, calendar and contact pages, the offline embedder, and joins by runs of characters."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions.embedding import HashEmbedder, embed_column
from quillmill.operators import calendar, candidates, canonical
from quillmill.plans.expansion import shared_folder
from quillmill.sources import contacts, events, remote


class Mails:
    """Three pages of ids; one message is gone for good, one fails twice."""

    def __init__(self, prefix, n=1100, broken=False):
        self.prefix, self.n, self.broken, self.asked = prefix, n, broken, 0

    def list_page(self, query, size, token):
        if self.broken:
            return remote.HttpFailure(403)
        at = int(token or 0)
        end = min(self.n, at + size)
        return [f"{self.prefix}{i}" for i in range(at, end)], str(end) if end < self.n else None

    def get(self, ids):
        self.asked += 1
        out = {i: {"id": i, "threadId": "t", "payload": {}} for i in ids}
        for i in ids:
            if i == f"{self.prefix}7":
                out[i] = remote.HttpFailure(404)
        return out


def test_search_without_limit_reads_all_and_says_what_failed():
    got = remote.Searcher(Mails("a"), sleep=lambda s: None).search_and_fetch("q")
    assert len(got.hits) == 1099 and not got.truncated and got.error == "fatal_client (404)"
    assert remote.Searcher(Mails("a"), limit=500, sleep=lambda s: None).search_and_fetch("q").truncated


def test_accounts_fail_apart():
    both = remote.AccountSearcher({"home": Mails("h", 20), "work": Mails("w", 20, broken=True)}, sleep=lambda s: None)
    got = both.search_and_fetch("q")
    assert len(got.hits) == 19 and {m["source_account"] for m in got.hits} == {"home"}
    assert got.error.startswith("[home] fatal_client (404); [work] fatal") and both.fetch("h3")["id"] == "h3"
    with pytest.raises(remote.Fatal):
        both.accounts["home"].fetch("h7")


def test_reader_gives_errors_as_rows():
    reader = remote.MailReader(Mails("a", 30), "q", None, 10)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 30 and [r[:3] for r in rows if r[3]] == [("a7", None, None)]
    with pytest.raises(remote.Fatal):
        remote.MailReader(Mails("a", 30, broken=True), "q", None, 10).partitions()


class Calendar:
    def list_page(self, name, since, size, token):
        at = int(token or 0)
        page = [{"summary": "Mia's birthday", "attendees": [{"email": "mia@gmail.com", "displayName": "Mia"}]}] * min(size, 600 - at)
        assert name == "primary" and since[4] == "-"
        return page, str(at + size) if at + size < 600 else None


def test_calendar_pages(spark):
    metrics = remote.Metrics()
    found = events.list_events(Calendar(), metrics)
    assert len(found) == 600 and not metrics.truncated
    assert len(events.list_events(Calendar(), metrics, limit=300)) == 300 and metrics.truncated

    rows = [(r[0], r[1]) for r in events.EventReader(Calendar(), 365, 1000, "primary").read(None)]
    raw = spark.createDataFrame([*rows[:5], (99, json.dumps({"summary": None}))], "seq bigint, json string")
    people = calendar.event_persons(events.events(raw)).collect()
    assert [(p["email"], p["n_events"], p["strength"]) for p in people if p["email"]] == [("mia@gmail.com", 5, 0.9)]


def test_contact_pages():
    class Book:
        def list_page(self, size, token):
            at = int(token or 0)
            return [{"resourceName": f"p{i}"} for i in range(at, min(2500, at + size))], str(at + size) if at + size < 2500 else None

    assert len(contacts.list_contacts(Book(), remote.Metrics())) == 2500


def test_embedder(spark):
    e = HashEmbedder()
    x = e.embed_batch(["Jane Smith", "jane  smith", "Jane", "Quarterly report", "", "Jane Smithe"])
    assert x.shape == (6, e.dim) and x.dtype == np.float32 and np.allclose(np.linalg.norm(x, axis=1), 1) and np.array_equal(x[0], x[1]) and np.array_equal(x[0], e.embed("Jane Smith"))
    assert min(x[0] @ x[5], x[0] @ x[2]) > 0.5 > x[0] @ x[3] and e.embed_batch([]).shape == (0, e.dim)
    df = spark.createDataFrame([("a", "Jane Smith"), ("b", None)], "k string, text string").repartition(2)
    got = {r["k"]: r["v"] for r in df.select("k", embed_column(e)(F.col("text")).alias("v")).collect()}
    assert got["b"] is None and np.allclose(got["a"], x[0])


def test_canonical_names_with_the_embedder(spark):
    shared_folder(spark)
    names = ["Jane Smith", "Jane", "Bob Smith", "Quentin"]
    stored = spark.createDataFrame([], "key string, kind string, model_id string, dim int, vector array<float>, created_at double")
    e = HashEmbedder()
    wanted = spark.createDataFrame([(n, "person", n) for n in names], "key string, kind string, text string")
    made = canonical.embed_missing(stored, wanted, embed_column(e), e.model_id)
    labels = made.select("kind", F.col("key").alias("label"), "vector")
    got = {r["label"]: r["canonical"] for r in canonical.canonical_map(labels, 0.55).collect()}
    assert got["Jane"] == got["Jane Smith"] == "Jane Smith" and got["Quentin"] == "Quentin" and got["Bob Smith"] == "Bob Smith"


def test_holders_by_brute_force(spark):
    rnd = random.Random(9)
    texts = [(i, " ".join("".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 8)))) for i in range(60)]
    needles = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 5))) for _ in range(30)})
    df = candidates.holders(spark.createDataFrame([*texts, (None, None)], "message_id int, low string"), spark.createDataFrame([(n,) for n in [*needles, ""]], "needle string"))
    assert {tuple(r) for r in df.collect()} == {(n, i) for n in needles for i, t in texts if n in t} and df.count() == df.distinct().count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_footers_are_cut_in_turn(spark):
    body = "Guests: Ann Lee <ann@gmail.com> https://www.google.com/calendar/event?x Bob Kim <bob@gmail.com>"
    df = spark.createDataFrame([("m", "Invitation: Dinner", body)], "message_id string, subject string, body string")
    assert [r["person"]["email"] for r in calendar.mail_persons(df).collect()] == ["ann@gmail.com"]


def test_mail_persons_are_calendar_persons(spark):
    rows = [(str(i), s, b) for i, (s, b) in enumerate([("Accepted: Mia birthday @ Thu May 28, 2026 9am", "Jana Bertram <jana@gmail.com>\nbob@corp.com"), ("Invitation: Family Dinner with Leo", "Leo <leo@gmail.com>"), (None, None), ("Standup", "x")])]
    df = spark.createDataFrame(rows, "message_id string, subject string, body string")
    want = df.select("message_id", F.explode(calendar.calendar_persons(F.col("subject"), F.col("body"))).alias("person"))
    assert sorted(map(str, calendar.mail_persons(df).collect())) == sorted(map(str, want.collect())) and want.count() > 3
