"""The search language, and where rows come from."""

import base64
import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.operators import corpus
from quillmill.plans.search import Atom, parse, search
from quillmill.sources import contacts, payload, remote
from quillmill.sources.markdown import read_messages

MAILS = os.path.join(os.path.dirname(__file__), "mails")


@pytest.fixture(scope="module")
def mails(spark):
    return read_messages(spark, MAILS).cache()


def test_parse():
    assert parse('a "b C" from:"x y" subject:z OR or cc:') == [[Atom("a"), Atom("b c"), Atom("x y", "from"), Atom("z", "subject")], [Atom("", "cc")]]
    assert parse("") == parse("OR or") == []
    assert parse('say "open end') == [[Atom("say"), Atom("open end")]]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='ab :"ORorfmu', max_size=25))
def test_parse_never_fails(query):
    assert all(isinstance(a, Atom) for g in parse(query) for a in g)


@pytest.mark.parametrize(
    "query,found",
    [
        ("family", "a01 a02 a05"), ("subject:family", "a01 a02 a05"), ("nora lunch", "a01 a02"), ("cake OR budget", "a02 a03 a04"), ('"family lunch" OR fund', "a01 a02 a04"), ("from:nora", "a01 a03"), ('from:"otto lind"', "a04"),
        ("cc:nora", "a02 a04"), ("to:me@example.com subject:photo", "a06"), ("", ""), ("or", ""), ("family OR nora budget", "a01 a02 a04 a05"),
    ],
)
def test_search(mails, query, found):
    assert sorted(r[0] for r in search(mails, query).select("message_id").collect()) == found.split()


def test_markdown(spark, mails, tmp_path):
    row = mails.where("message_id = 'a01'").first()
    assert (row["thread_id"], row["date"], row["from_addr"]) == ("t-a01", "2025-03-01 10:00:00+00:00", "Nora Berg <nora.berg@gmail.com>")
    assert row["body"].startswith("Nora here") and row["headers"] == {} and row["body_clean"] is None and row["is_bulk"] is False
    (tmp_path / "x.md").write_text("no front matter")
    with pytest.raises(Exception, match="no front matter"):
        read_messages(spark, str(tmp_path)).collect()
    (tmp_path / "x.md").write_text("---\nsubject: s\n---\nhi")
    row = read_messages(spark, str(tmp_path)).first()
    assert (row["message_id"], row["thread_id"], row["from_addr"], row["subject"], row["body"]) == ("x", "x", "", "s", "hi")


def test_corpus(spark, mails):
    import hashlib

    ids = sorted(r[0] for r in mails.select("message_id").collect())
    assert corpus.fingerprint(mails).first()[0] == "sha256:" + hashlib.sha256("".join(i + "\n" for i in ids).encode()).hexdigest()
    assert corpus.fingerprint(mails.limit(0)).first()[0] == "sha256:" + hashlib.sha256(b"").hexdigest()
    assert corpus.add(mails.where("message_id < 'a03'"), mails.union(mails)).count() == 6
    assert corpus.flag_bulk(mails).where("is_bulk").select("message_id").collect()[0][0] == "a05"
    both = corpus.union_accounts({"x": mails, "y": mails}, total=4)
    assert both.groupBy("source_account").count().orderBy("source_account").collect() == [("x", 2), ("y", 2)]


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def test_payload(spark):
    def part(mime, text, parts=None):
        return {"mimeType": mime, "body": {"data": b64(text)} if text else {}, **({"parts": parts} if parts else {})}

    headers = [{"name": "From", "value": "Ann <ann@corp.com>"}, {"name": "SUBJECT", "value": "old"}, {"name": "Subject", "value": "Accepted: Leo's birthday"}, {"name": "X-Y", "value": "z"}, {"name": "Date", "value": "Tue, 5 Mar 2024 10:20:30 +0100"}, {"name": "Precedence", "value": "bulk"}]
    tree = part("multipart/mixed", "", [part("multipart/alternative", "", [part("text/plain", "see calendar.google.com/calendar ü?>"), part("text/html", "<b>no</b>")]), part("text/plain", "two")])
    rows = [("1", "t1", json.dumps(tree | {"headers": headers})), ("2", None, json.dumps(part("text/html", "<p>Hi</p>") | {"headers": headers[:1]})), ("3", "t3", "{}"), (None, None, None)]
    got = {r["message_id"]: r for r in payload.messages(spark.createDataFrame(rows, "id string, threadId string, payload string")).collect()}
    assert got["1"]["body"] == "see calendar.google.com/calendar ü?>\n\ntwo" and got["1"]["subject"] == "Accepted: Leo's birthday" and got["1"]["date"] == "2024-03-05T10:20:30+01:00"
    assert got["1"]["is_bulk"] is False and got["1"]["calendar_persons"][0]["name"] == "Leo" and set(got["1"]["headers"]) == {"From", "Subject", "Date", "Precedence"}
    assert (got["2"]["thread_id"], got["2"]["body"], got["2"]["body_clean"]) == ("2", "<p>Hi</p>", "Hi")
    assert got["3"]["body"] == got[""]["body"] == ""


@pytest.mark.parametrize("date,iso", [("5 Mar 2024 10:20 GMT", "2024-03-05T10:20:00+00:00"), ("31 Feb 2024 10:20:30 +0000", "31 Feb 2024 10:20:30 +0000"), ("soon", "soon"), (None, ""), ("Fri, 01 Nov 2024 01:02:03 -0730 (X)", "2024-11-01T01:02:03-07:30")])
def test_dates(spark, date, iso):
    assert spark.createDataFrame([(date,)], "d string").select(payload.iso_date(F.col("d"))).first()[0] == iso


def test_base64(spark):
    rows = spark.createDataFrame([(b64("a?>ü"),), ("!!",), (None,), ("YQ",), ("YQ==",), ("Y",)], "d string")
    assert [r[0] for r in rows.select(payload.decode_base64url(F.col("d"))).collect()] == ["a?>ü", "", "", "a", "a", ""]


def test_contacts(spark):
    people = [
        {"resourceName": "p/1", "names": [{"displayName": "Ann", "familyName": "Berg"}], "emailAddresses": [{"value": " Ann@X.org"}, {"value": "ann@x.org"}], "relations": [{"person": "Bo", "type": "brother"}]},
        {"resourceName": "p/2", "emailAddresses": [{"value": "bo@x.org"}], "biographies": [{"value": "my Sister-in-law"}], "memberships": [{"contactGroupMembership": {"contactGroupResourceName": contacts.STARRED}}]},
        {"resourceName": "p/3"}, {"names": [{"displayName": "no id"}]}, {"resourceName": "p/4", "names": [{"displayName": "Cy"}]},
    ]
    rows = contacts.contacts(spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(people)], "seq int, json string"))
    got = [(r["display_name"], r["emails"], round(r["strength"], 2), r["source"]) for r in contacts.signals(rows, None, "berg").orderBy("seq").collect()]
    assert got == [("Ann", ["ann@x.org"], 0.9, "relations_field+surname"), ("bo", ["bo@x.org"], 0.75, "biography+starred"), ("Cy", [], 0.0, "")]
    assert [r["display_name"] for r in contacts.family_members(contacts.signals(rows)).collect()] == ["Ann", "bo"]
    groups = [("g/1", "Friends", 9), ("g/2", "Our Family", 3), ("g/3", "my-family", 5), ("g/4", "Family Office", 50), (contacts.FAMILY, "family", 0)]
    js = spark.createDataFrame([(json.dumps({"resourceName": r, "formattedName": n, "memberCount": c}),) for r, n, c in groups], "json string")
    assert contacts.family_group(contacts.groups(js)).first()["resource_name"] == "g/3"


@pytest.mark.parametrize(
    "status,reason,attempt,action",
    [
        (200, None, 1, "ok"), (401, None, 1, "refresh"), (401, None, 3, "fatal_client"), (403, "dailyLimitExceeded", 1, "fatal_quota"), (403, "userRateLimitExceeded", 1, "backoff_long"), (403, "rateLimitExceeded", 2, "backoff"),
        (403, "forbidden", 1, "fatal_client"), (429, None, 1, "backoff"), (429, None, 3, "fatal_client"), (503, None, 2, "backoff"), (404, None, 1, "fatal_client"),
    ],
)
def test_errors(status, reason, attempt, action):
    errors = [{"reason": reason}]
    body = {"error": {"errors": errors}} if reason else None
    assert remote.decide(remote.HttpFailure(status, body), attempt).action == action


def test_error_details():
    assert remote.decide(remote.HttpFailure(401, {"error": "invalid_grant"}), 1).action == "fatal_invalid_grant"
    assert remote.decide(remote.HttpFailure(429, None, "7"), 1).delay == 7.0
    assert [remote.backoff(a, rand=lambda: 0.5) for a in (1, 2, 3, 20)] == [0.5, 1.0, 2.0, 60.0]
    assert remote.read_failure(500, b"no json").body is None


class Service:
    """Twelve hundred messages; one of seven fails at first, one is gone."""

    def __init__(self):
        self.seen = set()

    def list_page(self, query, size, token):
        at = int(token or 0)
        ids = [f"{query}{i}" for i in range(at, min(1200, at + size))]
        return ids, str(at + size) if at + size < 1200 else None

    def get(self, ids):
        out = {}
        for i in ids:
            n = int(i[1:])
            out[i] = remote.HttpFailure(404) if n == 5 else remote.HttpFailure(503) if n % 7 == 0 and i not in self.seen else {"id": i, "threadId": "t", "payload": {"headers": []}}
            self.seen.add(i)
        return out


def test_paging_and_retries():
    m = remote.Metrics()
    ids = remote.list_ids(Service(), "q", 700, m)
    assert len(ids) == 700 and m.truncated and m.units == 2 * remote.LIST_UNITS
    m, waits = remote.Metrics(), []
    got = list(remote.get_messages(Service(), ids[:100], m, sleep=waits.append))
    assert len(got) == 99 and m.retries == 2 and m.error() == "fatal_client (404)" and m.units == 99 * remote.GET_UNITS
    assert not remote.list_ids(Service(), "q", 0, m)


def test_data_source(spark):
    class Fixture(remote.MailSource):
        @classmethod
        def name(cls):
            return "fixture_mail"

        def service(self):
            class Small:
                def list_page(self, query, size, token):
                    return [f"{query}{i}" for i in range(3)], None

                def get(self, ids):
                    return {i: {"id": i, "threadId": "t", "payload": {"headers": [{"name": "Subject", "value": i}]}} for i in ids}

            return Small()

    spark.dataSource.register(Fixture)
    rows = payload.messages(spark.read.format("fixture_mail").option("query", "q").option("batch", "2").load())
    assert sorted(r["subject"] for r in rows.collect()) == ["q0", "q1", "q2"]
