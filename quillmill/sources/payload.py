"""Messages from a mail service's JSON payloads.

A payload is a tree of parts of any depth, which no struct type can hold; it is read as a variant, level by level
down to DEPTH with built-in functions, and its parts keep the order of a walk in depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.address import is_bulk_message, is_calendar_mailer
from quillmill.functions.let import let
from quillmill.functions.text import clean_html, is_calendar_reply, strip, without_quotes
from quillmill.operators.calendar import calendar_persons
from quillmill.sources.schema import with_message_columns

#: Levels of parts below the payload itself.
DEPTH = 6
KEPT = ["From", "To", "Cc", "Bcc", "Subject", "Date", "Message-ID", "References", "In-Reply-To", "List-Unsubscribe", "List-Id", "List-Help", "Precedence", "Auto-Submitted"]

_HEADERS = "array<struct<name:string,value:string>>"


def decode_base64url(data: Column) -> Column:
    """The text in URL-safe base64, padded or not; '' for what can't be decoded, replacement characters for bad UTF-8."""
    return let(F.translate(F.regexp_replace(F.coalesce(data, F.lit("")), r"[=\s]+\z", ""), "-_", "+/"), _decoded)


def _decoded(s: Column) -> Column:
    padded = F.rpad(s, ((F.length(s) + 3) / 4).cast("int") * 4, "=")
    fine = s.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(s) % 4 != 1)
    raw = F.when(fine, F.try_to_binary(padded, F.lit("base64")))
    return F.coalesce(F.make_valid_utf8(raw.cast("string")), F.lit(""))


def _parts(payload: str, depth: int) -> str:
    """SQL for the parts of a payload (JSON text) as array<struct<place, part>>, in the order of a walk in depth; each is read once."""
    top = f"array(named_struct('place', array(0), 'part', {_read(payload)}))"
    below = (
        f"flatten(transform(s.level, p -> transform(coalesce(p.part.parts, array()), "
        f"(c, i) -> named_struct('place', concat(p.place, array(i)), 'part', {_read('c')}))))"
    )
    # what is kept of a level are its texts, as its parts are read for the next one
    step = f"(s, n) -> get(transform(array({below}), x -> named_struct('level', x, 'every', concat(s.every, {_LEAVES}))), 0)"
    every = f"get(transform(array({top}), x -> aggregate(sequence(1, {depth}), named_struct('level', x, 'every', {_LEAVES}), {step}).every), 0)"
    return f"array_sort({every}, (a, b) -> case when a.place < b.place then -1 when a.place > b.place then 1 else 0 end)"


_PART = "mimeType string, body struct<data:string>, parts array<string>"
_LEAVES = "transform(x, p -> named_struct('place', p.place, 'mime', p.part.mimeType, 'data', p.part.body.data))"


def _read(json: str) -> str:
    """SQL for one part, with strings of any length, which get_json_object has not."""
    return f"from_json({json}, '{_PART}', map('maxStringLen', '2147483647'))"


def body(payload: str = "payload") -> Column:
    """The text of all plain parts, else of all HTML parts, with blank lines between; payload is a column of JSON text."""
    texts = F.transform(
        F.expr(_parts(payload, DEPTH)),
        lambda p: F.struct(F.lower(F.coalesce(p["mime"], F.lit(""))).alias("mime"), decode_base64url(p["data"]).alias("text")),
    )

    def of(t: Column, kind: str) -> Column:
        return F.array_join(F.transform(F.filter(t, lambda x: (x["mime"] == kind) & (x["text"] != "")), lambda x: x["text"]), "\n\n")

    return let(texts, lambda t: strip(F.coalesce(F.nullif(of(t, "text/plain"), F.lit("")), of(t, "text/html"))))


def header_map(headers: Column) -> Column:
    """Headers by lower-case name; of several the last counts, those without name or value don't."""
    named = F.filter(
        F.transform(F.coalesce(headers, F.array().cast(_HEADERS)), lambda h: F.struct(F.lower(F.trim(F.coalesce(h["name"], F.lit("")))).alias("k"), h["value"].alias("v"))),
        lambda e: (e["k"] != "") & e["v"].isNotNull(),
    )

    def last(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["k"])
        return let(keys, lambda ks: F.filter(entries, lambda e, i: ~F.array_contains(F.slice(ks, i + 2, F.size(ks)), e["k"])))

    return F.map_from_entries(let(named, last))


def kept_headers(headers: Column) -> Column:
    """Those headers of a header_map that messages keep, by their usual names and in a fixed order."""

    def kept(h: Column) -> Column:
        return F.filter(F.array(*[F.struct(F.lit(k).alias("key"), h[k.lower()].alias("value")) for k in KEPT]), lambda e: e["value"].isNotNull())

    return F.map_from_entries(let(headers, kept))


def iso_date(date: Column) -> Column:
    """A mail header's date in ISO form with its own offset; the input where it can't be read, '' for null."""
    d = F.coalesce(date, F.lit(""))
    core = F.regexp_replace(F.trim(F.regexp_replace(d, r"\s*\([^)]*\)\s*$", "")), r"^[A-Za-z]{3,9},?\s+", "")
    numeric = F.regexp_replace(core, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    part = r"^(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}):(\d{2})(?::(\d{2}))?\s+([+-])(\d{2})(\d{2})$"
    g = [F.regexp_extract(numeric, part, i) for i in range(10)]
    month = F.array_position(F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), F.lower(g[2]))
    day = F.concat(g[3], F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(g[1], 2, "0"))
    out = F.concat(day, F.lit("T"), g[4], F.lit(":"), g[5], F.lit(":"), F.when(g[6] == "", "00").otherwise(g[6]), g[7], g[8], F.lit(":"), g[9])
    return F.when((g[0] != "") & (month > 0) & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull(), out).otherwise(d)


def messages(raw: DataFrame, user_emails=None) -> DataFrame:
    """Messages from rows of (id, threadId, payload, source_account), payload being JSON text.

    Bodies are cleaned of HTML and quotes; bulk mail is flagged, except replies of calendars; those give persons.
    """
    one = raw.select(
        F.coalesce(F.col("id"), F.lit("")).alias("message_id"),
        F.coalesce("threadId", "id", F.lit("")).alias("thread_id"),
        F.col("source_account") if "source_account" in raw.columns else F.lit("").alias("source_account"),
        header_map(F.from_json(F.get_json_object("payload", "$.headers"), _HEADERS)).alias("all_headers"),
        body("payload").alias("body"),
    )
    h = F.col("all_headers")
    two = one.select(
        "*",
        *[F.coalesce(h[k], F.lit("")).alias(n) for k, n in (("from", "from_addr"), ("to", "to_addr"), ("subject", "subject"))],
        iso_date(h["date"]).alias("date"),
        kept_headers(h).alias("headers"),
        without_quotes(clean_html(F.col("body"))).alias("body_clean"),
        F.concat(F.lit("gmail:"), F.col("message_id")).alias("source_path"),
    )
    reply = is_calendar_reply(F.col("subject"), F.col("body"))
    three = two.withColumn("is_bulk", ~reply & is_bulk_message(F.col("headers"), F.col("from_addr"), user_emails))
    invited = reply | is_calendar_mailer(F.col("from_addr"))
    return with_message_columns(three.withColumn("calendar_persons", F.when(invited, calendar_persons(F.col("subject"), F.col("body"))).otherwise(F.array())))
