"""Candidates: persons with their signals, ranked, with excerpts and the messages these come from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.address import any_personal, header_address, header_is_personal, name_of_address, sender_display
from quillmill.functions.names import alias_tokens, matches_alias, normalise, words
from quillmill.functions.text import sentence_around, strip
from quillmill.sources.schema import clean_text

MAX_CANDIDATES, MAX_MESSAGES, MAX_CALENDAR, MIN_CALENDAR, MIN_TOTAL = 50, 8, 5, 0.80, 3


def correspondents(messages: DataFrame, user_emails: Iterable[str]) -> DataFrame:
    """email, sent, received: personal addresses with mail in both directions and three messages or more.

    Only the first address of each header counts; the user's own is found anywhere in a header.
    """
    own = sorted({e.lower() for e in user_emails if e})
    if not own:
        return messages.sparkSession.createDataFrame([], "email string, sent bigint, received bigint")

    def mine(c: str):
        out = F.lit(False)
        for e in own:
            out = out | F.lower(F.coalesce(c, F.lit(""))).contains(e)
        return out

    from_me, to_me = mine("from_addr"), mine("to_addr")
    sender, receiver = header_address(F.col("from_addr")), header_address(F.col("to_addr"))
    to_them = F.when(from_me & ~to_me & header_is_personal(F.col("to_addr")), receiver)
    to_us = F.when(to_me & ~from_me & header_is_personal(F.col("from_addr")), sender)
    both = F.array_compact(F.array(F.struct(to_them.alias("email"), F.lit(1).alias("sent")), F.struct(to_us.alias("email"), F.lit(0).alias("sent"))))
    rows = messages.select(F.explode(both).alias("x")).where(F.col("x.email").isNotNull())
    return rows.groupBy(F.col("x.email").alias("email")).agg(F.count_if(F.col("x.sent") == 1).alias("sent"), F.count_if(F.col("x.sent") == 0).alias("received")).where(
        (F.col("sent") >= 1) & (F.col("received") >= 1) & (F.col("sent") + F.col("received") >= MIN_TOTAL)
    )


def holders(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """needle, message_id: which texts (message_id, low) hold which needles (needle, without white space); each pair once.

    A needle lies inside one of a text's runs without white space.  The distinct runs meet the needles in a join by
    up to three characters and are then checked, so that neither texts nor runs are compared with each needle.
    """
    runs = texts.select("message_id", F.explode_outer(F.array_distinct(F.split("low", r"\s+"))).alias("run")).where("run <> ''")
    at = F.sequence(F.lit(1), F.length("run"))
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substring(F.col("run"), i, F.lit(n)) for n in (1, 2, 3)]))))
    keyed = needles.select("needle", F.substring("needle", 1, 3).alias("gram")).where("needle <> ''").distinct()
    met = shuffled(runs.select("run").distinct().select("run", F.explode_outer(grams).alias("gram")), keyed, "gram").where(F.col("run").contains(F.col("needle"))).select("needle", "run")
    return shuffled(runs, met, "run").select("needle", "message_id").distinct()


def shuffled(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle.  What derives from texts is many times larger than the files it is estimated by, so that it would be broadcast through the driver."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def correspondent_names(messages: DataFrame, emails: DataFrame) -> DataFrame:
    """email, name: the first display name that a sender with the address has, by message id, else one made of the address."""
    hits = messages.select("message_id", F.lower(F.coalesce("from_addr", F.lit(""))).alias("low"), sender_display(F.col("from_addr")).alias("display")).where("display <> ''")
    met = holders(hits, emails.select(F.col("email").alias("needle"))).withColumnRenamed("needle", "email")
    first = shuffled(hits, met, "message_id").groupBy("email").agg(F.min_by("display", "message_id").alias("display"))
    return shuffled(emails.select("email"), first, "email", "left").select("email", F.coalesce("display", name_of_address(F.col("email"))).alias("name"))


def correspondent_messages(messages: DataFrame, emails: DataFrame, limit: int = MAX_MESSAGES) -> DataFrame:
    """email, message_id, subject, snippet: the latest messages of each address, by date as text and then id."""
    rows = messages.select("message_id", "date", "subject", F.lower(F.concat_ws("\n", "from_addr", "to_addr")).alias("low"), strip(F.substring(clean_text(), 1, 300)).alias("snippet"))
    hits = shuffled(rows, holders(rows, emails.select(F.col("email").alias("needle"))).withColumnRenamed("needle", "email"), "message_id")
    r = F.row_number().over(Window.partitionBy("email").orderBy(F.desc(F.coalesce("date", F.lit(""))), "message_id"))
    return hits.withColumn("r", r).where(F.col("r") <= limit).select("email", "message_id", "subject", "snippet", "r")


def calendar_hits(messages: DataFrame, persons: DataFrame, min_strength: float = MIN_CALENDAR) -> DataFrame:
    """label, message_id, snippet: messages whose calendar persons have a person's first word as theirs, five at most."""
    people = messages.select("message_id", "subject", strip(F.substring(clean_text(), 1, 200)).alias("text"), F.explode("calendar_persons").alias("p")).where(F.col("p.strength") >= min_strength)
    people = people.select("message_id", "subject", "text", F.lower(F.try_element_at(words(F.col("p.name")), F.lit(1))).alias("first")).distinct()
    labels = persons.select("label").distinct().withColumn("first", F.lower(F.try_element_at(words(F.col("label")), F.lit(1))))
    snippet = F.concat_ws(" — ", F.nullif("subject", F.lit("")), F.nullif("text", F.lit("")))
    hits = shuffled(labels, people, "first").select("label", "message_id", snippet.alias("snippet"))
    r = F.row_number().over(Window.partitionBy("label").orderBy("message_id"))
    return hits.withColumn("r", r).where(F.col("r") <= MAX_CALENDAR).drop("r")


def person_messages(messages: DataFrame, found: DataFrame) -> DataFrame:
    """label, message_id, extracted, in_header, in_body, personal: which messages speak of which person.

    found: message_id, label.  Messages meet the names whose first word they hold anywhere (see holders); headers and
    bodies of those are then checked for the whole name.
    """
    labels = found.select("label").distinct().withColumn("first", F.lower(F.try_element_at(words(F.col("label")), F.lit(1)))).where("first IS NOT NULL")
    text = F.lower(clean_text())
    rows = messages.select("message_id", F.lower(F.concat_ws("\n", "from_addr", "to_addr")).alias("head"), text.alias("low"), any_personal(F.col("from_addr"), F.col("to_addr")).alias("personal"))
    met = holders(rows.select("message_id", F.concat_ws("\n", "head", "low").alias("low")), labels.select(F.col("first").alias("needle"))).withColumnRenamed("needle", "first")
    pairs = shuffled(shuffled(labels, met, "first"), rows, "message_id")
    in_header = F.col("head").contains(F.col("first")) & (~F.col("label").contains(" ") | F.col("head").contains(F.lower("label")))
    pairs = pairs.select("label", "message_id", in_header.alias("in_header"), F.col("low").contains(F.lower("label")).alias("in_body"), "personal").where("in_header OR in_body")
    own = found.select("label", "message_id").distinct().withColumn("extracted", F.lit(True))
    known = rows.select("message_id", F.col("personal").alias("own_personal"))
    return (
        shuffled(shuffled(pairs, own, ["label", "message_id"], "full_outer"), known, "message_id", "left")
        .select("label", "message_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("extracted", "in_header", "in_body")], F.coalesce("personal", "own_personal", F.lit(False)).alias("personal"))
    )


def ranked(messages: DataFrame, found: DataFrame, canonical: DataFrame, user_emails: Iterable[str] = (), limit: int = MAX_CANDIDATES) -> DataFrame:
    """label, canonical, score, signals, message_ids, snippets: the candidates, best first.

    found: message_id, kind, label.  Score is the number of signals: sender_recipient (in a header of one message and
    the body of one), personal_domain (two extracted messages with a personal address), bidirectional, calendar.
    Signals rank, they don't decide.
    """
    people = found.where("kind = 'person'").select("message_id", "label").distinct()
    met = person_messages(messages, people)
    ids = F.slice(F.array_distinct(F.concat(F.array_sort(F.collect_set(F.when(F.col("extracted"), F.col("message_id")))), F.array_sort(F.collect_set(F.when(F.col("in_body"), F.col("message_id")))))), 1, MAX_MESSAGES)
    base = met.groupBy("label").agg(
        (F.bool_or("in_header") & F.bool_or("in_body")).alias("sender_recipient"), (F.count_if(F.col("extracted") & F.col("personal")) >= 2).alias("personal_domain"), ids.alias("message_ids")
    )
    names = canonical.where("kind = 'person'").select("label", "canonical")
    base = shuffled(base, names, "label", "left").withColumn("canonical", F.coalesce("canonical", "label"))

    mail = correspondents(messages, user_emails).select("email")
    letters = correspondent_messages(messages, mail).groupBy("email").agg(F.array_sort(F.collect_list(F.struct("r", "message_id", "snippet"))).alias("m"))
    letters = shuffled(shuffled(correspondent_names(messages, mail), letters, "email").select(F.col("name").alias("label"), "m"), names, "label", "left").withColumn("canonical", F.coalesce("canonical", "label"))
    letters = letters.groupBy("canonical").agg(F.min("label").alias("mail_label"), F.flatten(F.collect_list("m")).alias("m"), F.count("*").alias("n_mail"))
    letters = letters.select("canonical", "mail_label", "n_mail", F.transform("m", lambda x: x["message_id"]).alias("mail_ids"), F.transform("m", lambda x: F.struct(x["message_id"].alias("message_id"), x["snippet"].alias("snippet"))).alias("mail_snippets"))

    dates = shuffled(calendar_hits(messages, people), names, "label", "left").withColumn("canonical", F.coalesce("canonical", "label"))
    dates = dates.groupBy("canonical").agg(F.countDistinct("label").alias("n_calendar"), F.array_sort(F.collect_set("message_id")).alias("calendar_ids"), F.array_sort(F.collect_set(F.struct("message_id", "snippet"))).alias("calendar_snippets"))

    # signals of a canonical name go to one of its labels, the last in order
    last = Window.partitionBy("canonical").orderBy(F.desc("label"))
    base = base.withColumn("heir", F.row_number().over(last) == 1)
    extra = shuffled(letters, dates, "canonical", "full_outer")
    joined = base.hint("merge").join(extra.hint("merge"), (base["canonical"] == extra["canonical"]) & base["heir"], "full_outer").select(
        F.coalesce("label", "mail_label", extra["canonical"]).alias("label"),
        F.coalesce(base["canonical"], extra["canonical"]).alias("canonical"),
        F.coalesce("sender_recipient", F.lit(False)).cast("int").alias("s1"),
        F.coalesce("personal_domain", F.lit(False)).cast("int").alias("s2"),
        F.coalesce("n_mail", F.lit(0)).cast("int").alias("s3"),
        F.coalesce("n_calendar", F.lit(0)).cast("int").alias("s4"),
        F.slice(F.array_union(F.coalesce("message_ids", "mail_ids", F.array()), F.coalesce("calendar_ids", F.array())), 1, MAX_MESSAGES).alias("message_ids"),
        F.concat(F.coalesce("mail_snippets", F.array()), F.coalesce("calendar_snippets", F.array())).alias("snippets"),
    )
    signals = F.array_compact(F.array(*[F.when(F.col(c) > 0, n) for c, n in (("s1", "sender_recipient"), ("s2", "personal_domain"), ("s3", "bidirectional"), ("s4", "calendar"))]))
    rows = joined.select("label", "canonical", (F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")).alias("score"), signals.alias("signals"), "message_ids", "snippets")
    return rows.orderBy(F.desc("score"), "label").limit(limit)


def excerpts(candidates: DataFrame, messages: DataFrame) -> DataFrame:
    """canonical, label, score, signals, message_id, place, excerpt: the sentences that cite each candidate, each message once a canonical name."""
    rows = candidates.select("*", F.posexplode("message_ids").alias("place", "message_id"))
    first_of = Window.partitionBy("canonical", "message_id").orderBy(F.desc("score"), "label")
    rows = rows.withColumn("r", F.row_number().over(first_of)).where("r = 1").drop("r")
    rows = F.broadcast(rows).join(messages.select("message_id", clean_text().alias("text"), "from_addr", "subject", "source_account"), "message_id")
    first = F.coalesce(F.try_element_at(words(F.col("label")), F.lit(1)), F.col("label"))
    one, two = sentence_around(F.col("text"), first), sentence_around(F.col("text"), F.col("label"))
    own = F.try_element_at(F.filter("snippets", lambda s: s["message_id"] == F.col("message_id")), F.lit(1))["snippet"]
    known = F.arrays_overlap("signals", F.array(F.lit("bidirectional"), F.lit("calendar")))
    late = F.when(known, F.coalesce(F.nullif(own, F.lit("")), strip(F.substring("text", 1, 300)))).otherwise("")
    text = F.when(one != "", one).when(two != "", two).otherwise(late)
    return rows.select("canonical", "label", "score", "signals", "message_id", "place", text.alias("excerpt"), "from_addr", "subject", "source_account").where("excerpt <> ''")


def self_aliases(messages: DataFrame, display_name: str | None, email: str | None) -> DataFrame:
    """alias (array of words): the names by which the user is known: given, by address, and in mail of their own."""
    spark = messages.sparkSession
    given = spark.createDataFrame([(display_name or "",)], "name string").select(alias_tokens(F.col("name")).alias("alias"))
    local = (email or "").lower().split("@")[0].split("+")[0]
    named = spark.createDataFrame([([local],)] if local else [], "alias array<string>")
    out = given.unionByName(named)
    if email:
        sent = messages.where(F.lower(F.coalesce("from_addr", F.lit(""))).contains(email.lower())).select(sender_display(F.col("from_addr")).alias("name")).where("name <> ''")
        out = out.unionByName(sent.select(alias_tokens(F.col("name")).alias("alias")))
    return out.where(F.size("alias") > 0).distinct()


def without_self(rows: DataFrame, aliases: DataFrame, name: str = "canonical") -> DataFrame:
    """rows whose name is none of the user's."""
    mine = matches_alias(alias_tokens(rows[name]), aliases["alias"]) != ""
    return rows.join(aliases, mine, "left_anti")


def profile_members(cited: DataFrame) -> DataFrame:
    """name, n_messages, three signals, excerpts: the members of a profile by normalised name, in order."""
    grouped = cited.select(normalise(F.col("canonical")).alias("name"), "*").groupBy("name").agg(
        F.count("*").alias("n_messages"),
        *[F.bool_or(F.array_contains("signals", s)).alias(s) for s in ("bidirectional", "personal_domain", "calendar")],
        F.array_sort(F.collect_list(F.struct(F.negative("score").alias("rank"), "canonical", "place", "message_id", "excerpt", "from_addr", "subject", "source_account"))).alias("excerpts"),
    )
    return grouped.orderBy("name")


def footnotes(members: DataFrame, shown: int = 3) -> DataFrame:
    """name, message_id, excerpt, number: the excerpts that a profile shows, numbered by the first time their message is cited."""
    rows = members.select("name", F.posexplode(F.slice("excerpts", 1, shown)).alias("i", "e")).select("name", "i", "e.message_id", "e.excerpt", "e.subject", "e.source_account")
    first = rows.groupBy("message_id").agg(F.min(F.struct("name", "i")).alias("at"))
    number = first.select("message_id", F.dense_rank().over(Window.orderBy("at")).alias("number"))  # as many rows as a profile shows
    return rows.join(number, "message_id").select("name", "i", "message_id", "excerpt", "subject", "source_account", "number")
