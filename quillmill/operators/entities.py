"""Addresses and persons in messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.address import addresses_in, is_inline_image, sender_display
from quillmill.functions.names import canonical_label, clean_person, is_org_sentence, is_rejected, sender_is_personal, words
from quillmill.sources.schema import clean_text

#: (message_id, kind, key, label, confidence): which entity stands in which message.
ENTITY = ("kind", "key", "label")

#: A recogniser takes (message_id, text) and gives (message_id, span, sentence, is_person, is_proper).
Recogniser = Callable[[DataFrame], DataFrame]


def capitalised_spans(texts: DataFrame) -> DataFrame:
    """The built-in recogniser: runs of one to four capitalised words inside a sentence, not at its beginning unless of two words.

    It stands in for a trained model; give entities() another one for better recall.
    """
    sentences = texts.select("message_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n+")).alias("sentence"))
    spans = F.regexp_extract_all("sentence", F.lit(r"(?U)(?<![\w@.])(\p{Lu}[\w'’-]*(?:[ \t]+\p{Lu}[\w'’-]*){0,3})(?![\w@])"), F.lit(1))
    found = sentences.select("message_id", "sentence", F.explode(spans).alias("span"))
    inner = (F.instr(F.ltrim("sentence"), F.col("span")) > 1) | F.col("span").rlike(r"\s")
    return found.where(inner).select("message_id", "span", "sentence", F.lit(True).alias("is_person"), F.lit(True).alias("is_proper"))


def _entity(kind: str, key: Column, label: Column, confidence: Column) -> list[Column]:
    return [F.col("message_id"), F.lit(kind).alias("kind"), key.alias("key"), label.alias("label"), confidence.alias("confidence")]


def entities(messages: DataFrame, recogniser: Recogniser = capitalised_spans) -> DataFrame:
    """message_id, kind, key, label, confidence: addresses, senders and persons in messages that aren't bulk, each once a message."""
    kept = messages.where(~F.coalesce("is_bulk", F.lit(False))).select("message_id", "from_addr", "to_addr", clean_text().alias("text"))

    every = F.array_distinct(F.concat(addresses_in(F.col("text")), addresses_in(F.col("from_addr")), addresses_in(F.col("to_addr"))))
    addresses = kept.select("message_id", F.explode_outer(every).alias("a")).where(F.col("a").isNotNull() & ~is_inline_image(F.col("a")))
    mails = addresses.select(*_entity("email", F.col("a"), F.col("a"), F.lit("high")))

    named = kept.select("message_id", sender_display(F.col("from_addr")).alias("raw")).where(sender_is_personal(F.col("raw")))
    cleaned = named.select("message_id", canonical_label(clean_person(F.col("raw"))).alias("label")).where((F.col("label") != "") & ~is_rejected(F.col("label")))
    senders = cleaned.select(*_entity("person", F.lower("label"), F.col("label"), F.lit("medium")))

    # bulk mail is gone before the recogniser, which the optimiser would not do through Python
    spans = recogniser(kept.select("message_id", "text"))
    other = spans.where(~F.col("is_person")).select("message_id", F.lower("span").alias("low")).distinct()
    people = spans.where(F.col("is_person") & F.col("is_proper")).select("message_id", "span", "sentence", canonical_label(clean_person(F.col("span"))).alias("label"))
    people = people.where((F.col("label") != "") & ~is_rejected(F.col("label")))
    several = F.size(words(F.col("label"))) >= 2
    people = people.where(~(several & is_org_sentence(F.col("sentence"))))
    for c in ("span", "label"):
        people = people.join(other, (people["message_id"] == other["message_id"]) & (F.lower(people[c]) == other["low"]), "left_anti")
    bodies = people.select(*_entity("person", F.lower("label"), F.col("label"), F.when(F.size(words(F.col("label"))) >= 2, "high").otherwise("low")))
    return strongest(mails.unionByName(senders).unionByName(bodies))


def strongest(rows: DataFrame) -> DataFrame:
    """Each entity once a message, with its greatest confidence."""
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    return rows.groupBy("message_id", *ENTITY).agg(F.max_by("confidence", rank).alias("confidence"))


def calendar_entities(messages: DataFrame) -> DataFrame:
    """Persons and addresses that calendar mails brought with them, in the form of entities()."""
    people = messages.select("message_id", F.explode("calendar_persons").alias("p"))
    label = canonical_label(clean_person(F.col("p.name")))
    confidence = F.when(F.col("p.strength") >= 0.80, "high").when(F.col("p.strength") >= 0.65, "medium").otherwise("low")
    named = people.select("message_id", label.alias("label"), confidence.alias("confidence")).where((F.col("label") != "") & ~is_rejected(F.col("label")))
    mails = people.select("message_id", F.lower(F.trim("p.email")).alias("a")).where(F.col("a").contains("@"))
    return strongest(named.select(*_entity("person", F.lower("label"), F.col("label"), F.col("confidence"))).unionByName(mails.select(*_entity("email", F.col("a"), F.col("a"), F.lit("high")))))


def extract_delta(messages: DataFrame, ids: DataFrame, recogniser: Recogniser = capitalised_spans) -> DataFrame:
    """Entities of the messages with those ids only, calendars' persons included."""
    some = messages.join(ids.select("message_id").distinct(), "message_id", "left_semi")
    return strongest(entities(some, recogniser).unionByName(calendar_entities(some)))


def distinct_entities(rows: DataFrame) -> DataFrame:
    return rows.select(*ENTITY).distinct()


def new_entities(delta: DataFrame, before: DataFrame) -> DataFrame:
    return distinct_entities(delta).join(before.select(*ENTITY), list(ENTITY), "left_anti")


def recaptured(delta: DataFrame, before: DataFrame) -> DataFrame:
    return distinct_entities(delta).join(before.select(*ENTITY), list(ENTITY), "left_semi")


def recapture_rate(n_delta: Column, n_known: Column, n_hits: Column, n_new: Column) -> Column:
    """The greater of the shares of entities and of messages that were known; a search without hits has 1."""
    total, hits = F.greatest(n_delta, F.lit(1)), F.greatest(n_hits, F.lit(1))
    return F.greatest(n_known / total, (hits - n_new) / hits)


def by_canonical(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """One entity for each kind and canonical label: the one that is called so, else the one with the least label."""
    named = rows.join(canonical.select("kind", "label", "canonical"), ["kind", "label"], "left").withColumn("canonical", F.coalesce("canonical", "label"))
    best = Window.partitionBy("kind", "canonical").orderBy((F.col("label") != F.col("canonical")).cast("int"), "label", "key")
    return named.withColumn("r", F.row_number().over(best)).where("r = 1").select(*ENTITY)


def grounded(proposals: DataFrame, offered: DataFrame) -> DataFrame:
    """Proposals whose parent is one of the offered entities, written kind:label, exactly."""
    names = offered.select(F.concat_ws(":", "kind", "label").alias("parent_entity")).distinct()
    return proposals.join(names, "parent_entity", "left_semi")
