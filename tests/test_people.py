"""Entities, calendars, canonical names, candidates, profiles."""

import os

import pytest
from pyspark.sql import functions as F

from quillmill import tools
from quillmill.operators import calendar, candidates, canonical, entities, judge
from quillmill.plans.expansion import expand
from quillmill.sources import profile
from quillmill.sources.markdown import read_messages

MAILS = os.path.join(os.path.dirname(__file__), "mails")


@pytest.fixture(scope="module")
def mails(spark):
    return read_messages(spark, MAILS).cache()


def nobody(texts):
    return texts.select("message_id", F.lit("").alias("span"), F.lit("").alias("sentence"), F.lit(True).alias("is_person"), F.lit(True).alias("is_proper")).limit(0)


def test_entities(spark, mails):
    rows = entities.entities(mails.withColumn("is_bulk", F.col("message_id") == "a05"))
    got = {(r["message_id"], r["kind"], r["label"]): r["confidence"] for r in rows.collect()}
    assert got["a01", "person", "Nora Berg"] == "medium" and got["a01", "email", "nora.berg@gmail.com"] == "high"
    assert not [k for k in got if k[0] == "a05"]
    assert got["a06", "person", "Ida Holm"] == "medium" and got["a06", "person", "Nora Berg"] == "high" and got["a06", "email", "ida@icloud.com"] == "high"
    assert ("a04", "person", "Petra Holm") not in got  # in a law firm's sentence
    assert len(rows.collect()) == len(got)


def test_recogniser(spark, mails):
    def spans(texts):
        one = lambda span, person: texts.select("message_id", F.lit(span).alias("span"), F.lit("s").alias("sentence"), F.lit(person).alias("is_person"), F.lit(True).alias("is_proper"))
        return one("Ann Berg", True).union(one("Oslo City", True)).union(one("Lund Vik", True)).union(one("lund vik", False))

    got = entities.entities(mails.where("message_id = 'a03'"), spans).where("kind = 'person' AND confidence = 'high'").collect()
    assert [r["label"] for r in got] == ["Ann Berg"]


def test_attendees(spark):
    body = "Guests\nJana Bertram <jana@gmail.com>\nJ <Jana@Gmail.com>\nbob@corp.com\nroom@x.calendar.google.com, noreply@x.org\nUnsubscribe \nlate@x.org"
    df = spark.createDataFrame([("Accepted: Vitus Birthday in school @ Thu May 28, 2026 9am", body), (None, None), ("Invitation: Standup", "ann@corp.com\nJo <jo@gmail.com>")], "s string, b string")
    got = [[(p["name"], p["email"], p["source"], p["strength"], p["signal"]) for p in r[0]] for r in df.select(calendar.calendar_persons(F.col("s"), F.col("b"))).collect()]
    assert got[0] == [("Vitus", None, "event_title", 0.85, "kinship_event"), ("bob", "bob@corp.com", "attendee", 0.65, "family_event_attendee"), ("Jana Bertram", "jana@gmail.com", "attendee", 0.65, "family_event_attendee")]
    assert got[1] == [] and got[2] == [("Jo", "jo@gmail.com", "attendee", 0.65, "personal_attendee"), ("ann", "ann@corp.com", "attendee", 0.5, "weak")]


def test_events(spark):
    kind = "event_id int, summary string, attendees array<struct<email:string,displayName:string,self:boolean,resource:boolean,organizer:boolean>>"
    rows = [(i, f"Mia's birthday {i}", [("mia@gmail.com", "Mia", None, None, None), ("me@x.org", None, True, None, None)]) for i in range(3)] + [(9, "Standup", [("bo@corp.com", None, None, None, None)]), (10, None, None), (11, "Leo family", [])]
    got = {r["name"]: (r["email"], r["n_events"], r["strength"], r["source"]) for r in calendar.event_persons(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"Mia": ("mia@gmail.com", 3, 0.95, "recurring_family_event+possessive_in_title"), "bo": ("bo@corp.com", 1, 0.40, "weak"), "Leo": (None, 0, 0.80, "kinship_event")}
    evidence = {r["contact_name"]: r for r in calendar.person_evidence(calendar.event_persons(spark.createDataFrame(rows, kind))).collect()}
    assert evidence["Leo"]["relations"] == ["calendar_family: (event title)"] and evidence["Leo"]["biography"] == "Calendar: 'Leo family'"


def test_canonical(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [("person", "Jane Smith", near), ("person", "Jane", near), ("person", "Jane Smith Lee", near), ("person", "Bob", near), ("person", "Bob Smith", far), ("org", "Jane", near), ("person", "Al", near), ("person", "Al Smith", near)]
    df = spark.createDataFrame(rows, "kind string, label string, vector array<float>")
    got = {(r["kind"], r["label"]): r["canonical"] for r in canonical.canonical_map(df).collect()}
    assert got == {("person", "Jane Smith"): "Jane Smith Lee", ("person", "Jane"): "Jane Smith Lee", ("person", "Jane Smith Lee"): "Jane Smith Lee", ("person", "Bob"): "Bob", ("person", "Bob Smith"): "Bob Smith", ("org", "Jane"): "Jane", ("person", "Al"): "Al", ("person", "Al Smith"): "Al Smith"}
    assert canonical.canonical_map(df.limit(0)).count() == 0


def test_vectors(spark):
    old = spark.createDataFrame([("a", "q", "m", 1, [1.0], 1.0), ("b", "n", "m", 1, [2.0], 1.0)], canonical.VECTOR)
    new = spark.createDataFrame([("a", "q", "m", 1, [3.0], 1.0), ("c", "q", "m", 1, [4.0], 2.0), ("c", "q", "m", 1, [5.0], 3.0)], canonical.VECTOR)
    both = canonical.upsert_vectors(old, new)
    assert {r["key"]: r["vector"] for r in both.collect()} == {"a": [3.0], "b": [2.0], "c": [5.0]}
    assert [r["key"] for r in canonical.delete_kind(both, "q").collect()] == ["b"] and canonical.vectors_of_kind(both, "q").count() == 2
    wanted = spark.createDataFrame([("a", "q", "x"), ("d", "q", "yy")], "key string, kind string, text string")
    made = canonical.embed_missing(both, wanted, lambda t: F.array(F.length(t).cast("float")), "m2")
    assert {r["key"]: (r["vector"], r["model_id"]) for r in made.where("key in ('a', 'd')").collect()} == {"a": ([3.0], "m"), "d": ([2.0], "m2")}


def test_correspondents(spark, mails):
    assert [tuple(r) for r in candidates.correspondents(mails, ["ME@example.com"]).collect()] == [("nora.berg@gmail.com", 1, 2)]
    assert candidates.correspondents(mails, []).count() == 0
    found = candidates.correspondents(mails, ["me@example.com"])
    assert candidates.correspondent_names(mails, found).first()["name"] == "Nora Berg"
    assert [r["message_id"] for r in candidates.correspondent_messages(mails, found).orderBy("r").collect()] == ["a04", "a03", "a02", "a01"]


def test_candidates(spark, mails):
    found = entities.entities(mails)
    best = candidates.ranked(mails, found, canonical.identity_map(found), ["me@example.com"]).collect()
    assert (best[0]["label"], best[0]["score"], best[0]["signals"]) == ("Nora Berg", 3, ["sender_recipient", "personal_domain", "bidirectional"])
    assert {r["label"] for r in best} >= {"Nora Berg", "Otto Lind", "Ida Holm"}
    cited = candidates.excerpts(spark.createDataFrame(best), mails)
    nora = cited.where("label = 'Nora Berg' AND message_id = 'a01'").first()
    assert nora["excerpt"] == "Nora here, your sister."
    aliases = candidates.self_aliases(mails, "Ida Holm", "me+x@example.com")
    assert sorted(tuple(r["alias"]) for r in aliases.collect()) == [("ida", "holm"), ("me",)]
    assert "Ida Holm" not in {r["label"] for r in candidates.without_self(cited, aliases).collect()}
    members = candidates.profile_members(cited)
    notes = candidates.footnotes(members).orderBy("number").collect()
    assert [n["number"] for n in notes][0] == 1 and len({n["message_id"] for n in notes}) == max(n["number"] for n in notes)


def test_expansion_and_profile(spark, mails, tmp_path):
    status = str(tmp_path / "status.json")
    result, path = tools.build_profile(mails, "my family", str(tmp_path / "p"), email="me@example.com", status=status, recogniser=nobody)
    assert [r[1] for r in result.iterations][0] == "subject:family" and result.iterations[0][3:6] == (3, 3, 4)
    assert result.stop.rule.startswith("frontier_exhausted") and tools.build_status(status)["state"] == "done" and result.iteration_table().count() == len(result.iterations)
    text = open(path).read()
    assert text.startswith("---\nschema_version: 1\n") and '### Nora Berg' in text and "[^1]: gmail:" in text
    profiles = tools.open_profiles(spark, str(tmp_path / "p"))
    names = [r["member"] for r in profile.members_of(profiles).collect()]
    assert "Nora Berg" in names and tools.profile_health(profiles).first()["n_members"] == len(names)
    assert any(r["section"].startswith("### Nora Berg") for r in tools.who_is(profiles, "nora b").collect()) and tools.who_is(profiles, " ").count() == 0
    assert "told apart" in tools.about_me(profiles, "told apart").first()["text"] and tools.about_me(profiles, "no such topic").count() == 0
    assert tools.about_me(profiles, "canonical_name").count() >= 1 and tools.about_me(profiles, " ").count() == 0
    assert tools.about_me(profiles).first()["text"].startswith("---") and profile.latest(profiles).count() == 1
    assert tools.reset_profiles(str(tmp_path / "p")) == [path] and os.path.exists(path)
    assert tools.reset_profiles(str(tmp_path / "p"), [status], confirm=True) == [path, status] and not os.path.exists(path)


def test_expansion_without_hits(spark, mails):
    result = expand(mails, "zzz", recogniser=nobody)
    assert result.iterations[0][3:8] == (0, 0, 0, 0, 1.0) and result.stop.rule == "frontier_exhausted_no_yield"


def test_tools(spark, mails):
    two = mails.withColumn("source_account", F.when(F.col("message_id") < "a04", "x").otherwise("y"))
    assert tools.search_messages(two, "e", 2).groupBy("source_account").count().orderBy("source_account").collect() == [("x", 1), ("y", 1)]
    assert tools.search_messages(two, "nothing like it").count() == 0
    long = mails.withColumn("body", F.repeat(F.lit("x"), 10_005))
    assert tools.read_message(long, "a01").first()["body"].endswith("[truncated — full message is 10005 chars]") and tools.read_message(long, "zz").count() == 0


def test_judge(spark):
    kind = "canonical string, texts array<string>, contact struct<strength:double,in_family_group:boolean,relations:array<string>>"
    rows = [("Ann Berg", ["x"], (0.9, False, ["brother: Bo"])), ("Ann Lind", [], None), ("Cy Holm", ["My uncle Cy came"], None), ("Di", ["Di came"], (0.3, False, [])), ("Ed Vik", ["Ed"], None), ("Flo", None, (0.1, True, []))]
    got = [(r["decision"], r["relation_guess"], r["confidence"]) for r in judge.judged(spark.createDataFrame(rows, kind), "lind", True).collect()]
    assert got == [("family", "sibling", 0.95), ("family", "other", 0.75), ("family", "aunt_or_uncle", 0.6), ("uncertain", None, 0.3), ("not_family", None, 0.5), ("family", "other", 0.95)]
    answers = spark.createDataFrame([('{"decision": "FAMILY", "confidence": 7}',), ('{"decision": "maybe"}',), ("no json",), ('{"decision": "uncertain", "confidence": "much"}',)], "json string")
    assert [r["verdict"] and (r["verdict"]["decision"], r["verdict"]["confidence"]) for r in judge.read_verdicts(answers).collect()] == [("family", 1.0), None, None, ("uncertain", 0.5)]


def test_stream(spark, mails, tmp_path):
    from quillmill.streaming import ingest

    inbox = str(tmp_path / "in")
    mails.where("message_id < 'a04'").coalesce(1).write.parquet(inbox)
    out, found = str(tmp_path / "corpus"), str(tmp_path / "entities")
    for _ in range(2):
        ingest.ingest(ingest.message_stream(spark, inbox), out, found, str(tmp_path / "state"), nobody).awaitTermination()
        mails.where("message_id > 'a02'").coalesce(1).write.mode("append").parquet(inbox)
    got = spark.read.parquet(out)
    assert sorted(r[0] for r in got.select("message_id").collect()) == ["a01", "a02", "a03", "a04", "a05", "a06"]
    assert got.where("message_id = 'a05'").first()["is_bulk"] and "wrote" not in got.where("message_id = 'a02'").first()["body_clean"]
    assert spark.read.parquet(found).where("kind = 'email'").count() > 6
