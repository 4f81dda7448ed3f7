"""Persons in calendar mails and calendar events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.address import ANGLE_ADDRESS, NAME, domain, is_attendee_address, is_personal_domain
from quillmill.functions.let import let
from quillmill.functions.names import clean_display, has_kinship_word, names_in_title
from quillmill.functions.text import event_title
from quillmill.functions.vocabulary import EVIDENCE_DOMAINS

#: Where a calendar service's footer may begin; texts are cut at each in turn.
_ENDS = ["Unsubscribe ", "You are receiving this", "Forwarding this invitation", "google.com/calendar/event?", "https://www.google.com/calendar"]
_PERSON = "struct<name:string,email:string,source:string,event_title:string,strength:double,signal:string,words:array<string>>"


def attendees(body: Column) -> Column:
    """array of (name, email): the guests in a calendar mail's body, each address once, in the order of the text.

    Named addresses come first, with the longest of their names, then bare ones, named by their local part.
    """
    t = F.coalesce(body, F.lit(""))
    for end in _ENDS:
        t = F.substring_index(t, end, 1)
    return let(t, _guests)


def _guests(t: Column) -> Column:
    pattern = rf"(?U)([A-Za-z][-',. \w]*?)\s*{ANGLE_ADDRESS}"
    named = F.transform(
        F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("e")),
        lambda x: F.struct(clean_display(F.trim(x["n"], F.lit(" -\t,;:"))).alias("name"), F.lower(F.trim(x["e"])).alias("email")),
    )
    named = F.transform(named, lambda x: F.struct(F.when(x["name"] == "", F.substring_index(x["email"], "@", 1)).otherwise(x["name"]).alias("name"), x["email"].alias("email")))
    named = F.filter(named, lambda x: is_attendee_address(x["email"]))
    longer = lambda p, q: F.when(F.length(p["name"]) > F.length(q["name"]), -1).when(F.length(p["name"]) < F.length(q["name"]), 1).otherwise(0)
    best = let(named, lambda a: F.transform(a, lambda x: F.struct(F.get(F.array_sort(F.filter(a, lambda y: y["email"] == x["email"]), longer), F.lit(0))["name"].alias("name"), x["email"].alias("email"))))
    bare = F.transform(F.regexp_extract_all(t, F.lit(rf"(?U)\b({NAME}@[-.\w]+\.[A-Za-z]{{2,}})\b"), F.lit(1)), lambda e: F.struct(F.substring_index(F.lower(e), "@", 1).alias("name"), F.lower(e).alias("email")))
    bare = F.filter(bare, lambda x: is_attendee_address(x["email"]))
    return let(F.concat(best, bare), lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["email"] == x["email"])))


def calendar_persons(subject: Column, body: Column) -> Column:
    """array of persons in a calendar mail: those its title names and its guests, one entry where they have one name.

    Strongest first, then by name.  A name in a title counts 0.9 if possessive, else 0.85; a guest 0.65 at an event
    with a word of kinship or with a personal address, else 0.5; a guest whom the title names has the greater.
    """
    return let(event_title(subject), lambda title: let(names_in_title(title), lambda named: let(attendees(body), lambda guests: _merged(title, named, guests))))


def mail_persons(messages: DataFrame) -> DataFrame:
    """message_id, person: calendar_persons of the rows (message_id, subject, body), one row for each person.

    Title, names and guests are columns of their own, each made once, before they are merged.
    """
    rows = messages.select("message_id", event_title(F.col("subject")).alias("title"), "body")
    rows = rows.select("message_id", "title", names_in_title(F.col("title")).alias("titled"), attendees(F.col("body")).alias("invited"))
    # explode_outer, as a filter that is derived from explode would make the array a second time
    rows = rows.select("message_id", F.explode_outer(_merged(F.col("title"), F.col("titled"), F.col("invited"))).alias("person"))
    return rows.where("person IS NOT NULL")


def _merged(title: Column, titled: Column, invited: Column) -> Column:
    family = has_kinship_word(title)

    def signal(detector: Column) -> tuple[Column, Column]:
        owned = detector == "possessive_in_title"
        return F.when(owned, 0.90).otherwise(0.85), F.when(owned, "possessive_in_title").otherwise("kinship_event")

    def guest(x: Column) -> Column:
        first = F.try_element_at(F.filter(titled, lambda y: F.lower(y["name"]) == F.lower(x["name"])), F.lit(1))
        own = F.when(family, 0.65).when(is_personal_domain(domain(x["email"])), 0.65).otherwise(0.50)
        why = F.when(family, "family_event_attendee").when(is_personal_domain(domain(x["email"])), "personal_attendee").otherwise("weak")
        has = first.isNotNull()
        strength, tag = signal(first["detector"])
        return F.struct(
            x["name"].alias("name"),
            x["email"].alias("email"),
            F.when(has, "both").otherwise("attendee").alias("source"),
            title.alias("event_title"),
            F.when(has, strength).otherwise(own).cast("double").alias("strength"),
            F.when(has, tag).otherwise(why).alias("signal"),
            F.when(has, F.array(first["word"])).otherwise(F.array().cast("array<string>")).alias("words"),
        )


    def named(x: Column) -> Column:
        strength, tag = signal(x["detector"])
        return F.struct(
            x["name"].alias("name"),
            F.lit(None).cast("string").alias("email"),
            F.lit("event_title").alias("source"),
            title.alias("event_title"),
            strength.cast("double").alias("strength"),
            tag.alias("signal"),
            F.array(x["word"]).alias("words"),
        )

    alone = F.transform(F.filter(titled, lambda x: ~F.exists(invited, lambda g: F.lower(g["name"]) == F.lower(x["name"]))), named)
    every = F.concat(F.transform(invited, guest).cast(f"array<{_PERSON}>"), alone.cast(f"array<{_PERSON}>"))
    order = lambda a, b: (
        F.when(a["strength"] > b["strength"], -1).when(a["strength"] < b["strength"], 1).when(F.lower(a["name"]) < F.lower(b["name"]), -1).when(F.lower(a["name"]) > F.lower(b["name"]), 1).otherwise(0)
    )
    return F.array_sort(every, order)


def event_persons(events: DataFrame) -> DataFrame:
    """Persons over all events of a calendar, from rows (event_id, summary, attendees).

    attendees: array of structs with email, displayName, self, resource, organizer.  Persons are guests by address
    and names in titles; a name in titles that a guest has is merged into the guest.  Columns: name, email,
    is_attendee, titles, n_events, words, strength, source.
    """
    title = F.trim(F.coalesce("summary", F.lit("")))
    rows = events.select("event_id", title.alias("title"), has_kinship_word(title).alias("family"), "attendees")
    found = rows.select("event_id", "title", F.explode_outer(names_in_title(F.col("title"))).alias("x")).where("x IS NOT NULL").select(
        F.lower("x.name").alias("key"), F.col("x.name").alias("name"), "title", "event_id", F.array_compact(F.array("x.word", F.when(F.col("x.detector") == "possessive_in_title", "possessive"))).alias("words")
    )
    named = found.groupBy("key").agg(F.min_by("name", "event_id").alias("name"), F.collect_set(F.nullif("title", F.lit(""))).alias("titles"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))

    guest = rows.select("event_id", "title", "family", F.explode("attendees").alias("a")).select(
        "event_id", "title", "family", F.lower(F.trim(F.coalesce("a.email", F.lit("")))).alias("email"), F.trim(F.coalesce("a.displayName", F.lit(""))).alias("display"),
        F.coalesce("a.self", F.lit(False)).alias("own"), F.coalesce("a.resource", F.lit(False)).alias("room"), F.coalesce("a.organizer", F.lit(False)).alias("host"),
    )
    shared = F.col("host") & (F.col("display") == "") & F.col("email").endswith(".calendar.google.com")
    guest = guest.where((F.col("email") != "") & ~F.col("own") & ~F.col("room") & ~shared)
    local = F.substring_index("email", "@", 1)
    guests = guest.groupBy("email").agg(
        F.coalesce(F.min_by(F.when(F.col("display") != "", F.col("display")).otherwise(local), "event_id"), F.lit("")).alias("name"),
        F.collect_set(F.nullif("title", F.lit(""))).alias("titles"),
        F.count("*").alias("n_events"),
        F.collect_set(F.when(F.col("family"), "attendee_family_event")).alias("words"),
    )
    both = guests.alias("g").join(named.alias("n"), F.lower("g.name") == F.col("n.key"), "full_outer").select(
        F.coalesce("g.name", "n.name").alias("name"), F.col("g.email").alias("email"), F.col("g.email").isNotNull().alias("is_attendee"),
        F.array_sort(F.array_union(F.coalesce("g.titles", F.array()), F.coalesce("n.titles", F.array()))).alias("titles"), F.coalesce("g.n_events", F.lit(0)).alias("n_events"),
        F.array_sort(F.array_union(F.coalesce("g.words", F.array()), F.coalesce("n.words", F.array()))).alias("words"),
    )
    return scored_persons(both)


def scored_persons(persons: DataFrame) -> DataFrame:
    """Persons with strength, the greatest of their signals, and source, the names of all, joined by +."""
    kin = F.size(F.filter("titles", has_kinship_word))
    possessive = F.exists("words", lambda w: (w == "possessive") | w.endswith("'s"))
    occasion = F.coalesce(*[F.when(F.array_contains("words", w), f"{w}_event") for w in ("birthday", "anniversary", "wedding")], F.lit("kinship_event"))
    frequent = F.col("is_attendee") & (F.col("n_events") >= 5) & F.lower(F.regexp_extract("email", r"^[^@]*@(.*)$", 1)).isin(sorted(EVIDENCE_DOMAINS))
    earlier = (kin >= 1) | possessive | F.coalesce(frequent, F.lit(False))
    rules = [(kin >= 3, 0.95, F.lit("recurring_family_event")), (possessive, 0.90, F.lit("possessive_in_title")), ((kin >= 1) & (kin < 3), 0.80, occasion), (frequent, 0.70, F.lit("frequent_attendee_personal"))]
    strength = F.greatest(*[F.when(F.coalesce(c, F.lit(False)), s).otherwise(0.0) for c, s, _ in rules], F.when(~earlier, 0.40).otherwise(0.0))
    source = F.concat_ws("+", *[F.when(F.coalesce(c, F.lit(False)), n) for c, _, n in rules], F.when(~earlier, "weak"))
    return persons.select("*", strength.alias("strength"), source.alias("source"))


def listed_persons(persons: DataFrame) -> DataFrame:
    """Persons with a signal that isn't weak, in the order of listings."""
    return persons.where("strength >= 0.5").orderBy(F.desc("strength"), F.desc("n_events"), F.lower("name"))


def person_evidence(persons: DataFrame) -> DataFrame:
    """Persons as contact evidence: words of kinship as relations, up to three titles as biography."""
    relations = F.transform(F.filter("words", lambda w: ~w.isin("attendee_family_event", "possessive")), lambda w: F.concat(F.lit("calendar_"), w, F.lit(": (event title)")))
    titles = F.array_join(F.transform(F.slice("titles", 1, 3), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    return persons.select(
        F.col("name").alias("contact_name"),
        F.array_compact(F.array("email")).alias("emails"),
        "strength",
        F.concat(F.lit("calendar:"), F.col("source")).alias("source"),
        relations.alias("relations"),
        F.when(titles == "", "Calendar evidence (no title preview available)").otherwise(F.concat(F.lit("Calendar: "), titles)).alias("biography"),
        F.lit(False).alias("in_family_group"),
    )


def by_source_tag(rows: DataFrame) -> DataFrame:
    """How many rows have each tag of a +-joined source, the most frequent first."""
    return rows.select(F.explode(F.split("source", r"\+")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def first_by_address(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """For each wanted address (email) the first contact that has it, or nulls; contacts: seq, display_name, emails."""
    wanted = emails.select(F.lower(F.trim("email")).alias("email")).where("email <> ''").distinct()
    each = contacts.select("seq", "display_name", F.explode("emails").alias("email")).select("seq", "display_name", F.lower("email").alias("email"))
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("email").orderBy("seq"))).where("r = 1").drop("r")
    return wanted.join(first, "email", "left")
