"""Text as Column expressions: HTML, quotes, snippets, sections.  Python is used only where no built-in function exists."""

from __future__ import annotations

import difflib
import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.let import let

_BOX = "border margin padding".split()
_PROPERTIES = (
    [*_BOX, *(f"{b}-{s}" for b in _BOX for s in "bottom left right top".split()), *(f"border-{x}" for x in "color radius style width".split())]
    + "background background-color background-image color display height letter-spacing line-height max-height max-width min-height min-width".split()
    + [*(f"font-{x}" for x in "family size style weight".split()), *(f"text-{x}" for x in "align decoration transform".split()), "vertical-align", "width"]
)
_GAP, _VALUE, _BLANK = r"[ \t]*", r"[^\n;]+", r"(?:[\t ]*\n)"
#: Lines that consist of one of these are a mailing's footer.
_FOOTERS = [
    "add us to your address book",
    "if you (?:don't want|no longer wish) to receive these emails",
    "manage (?:your )?preferences",
    "privacy policy",
    "this email was sent to .+",
    "unsubscribe",
    "update (?:your |)(?:email |)preferences",
    "view (?:this |)(?:message|email) in (?:a |your |)browser",
]


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references of HTML replaced by what they stand for."""
    return text.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of two texts (Ratcliff and Obershelp)."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def without_blocks(text: Column) -> Column:
    """Scripts, style sheets and tags replaced by spaces."""
    t = F.coalesce(text, F.lit(""))
    for name in ("script", "style"):
        t = F.regexp_replace(t, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    for name in ("script", "style"):
        t = F.regexp_replace(t, rf"(?i)<{name}\b[^>]*/>", " ")
    return F.regexp_replace(t, "<[^>]+>", " ")


def without_css(text: Column) -> Column:
    """Style declarations, colours and footer lines taken out, white space put in order."""
    names = "|".join(sorted(_PROPERTIES, key=lambda p: (-len(p), p)))
    t = F.regexp_replace(text, rf"(?iU)\b(?:{names})\s*:\s*{_VALUE};?", " ")
    t = F.regexp_replace(t, rf"(?imd)^{_GAP}[a-z-]+{_GAP}:{_GAP}{_VALUE};{_GAP}$", "")
    t = F.regexp_replace(t, r"(?iU)(?<!\w)#(?:[0-9a-f]{3,4}|(?:[0-9a-f]{2}){3,4})(?!\w)", " ")
    t = F.regexp_replace(t, r"(?iU)\b(?:hsl|rgb)a?\s*\([^)]*\)", " ")
    t = F.regexp_replace(t, rf"(?imd)^[ \t]*(?:{'|'.join(_FOOTERS)})[ \t.!]*$", "")
    t = F.regexp_replace(t, r"[ \t\f\x0B]+", " ")
    t = F.regexp_replace(t, _BLANK + "{3,}", "\n\n")
    t = F.array_join(F.transform(F.split(t, "\n"), strip), "\n")
    return strip(F.regexp_replace(t, _BLANK + "{3,}", "\n\n"))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def clean_html(text: Column) -> Column:
    """HTML or text with leaked style sheets as plain text; '' for null."""
    return without_css(unescape(without_blocks(text)))


_SOME = ".{0,80}"
_MARKS = [
    rf"^On {_SOME}wrote:\s*$",
    rf"^Le {_SOME}a écrit\s*:\s*$",
    rf"^Am {_SOME}schrieb {_SOME}:\s*$",
    r"^--+\s*Forwarded message\s*--+",
    r"^Begin forwarded message:\s*$",
]
_FOOTNOTES = [r"^Sent from my (?:Android|iPad|iPhone|Samsung).*$", r"^Get Outlook for (?:Android|iOS).*$"]


def without_quotes(text: Column) -> Column:
    """A reply's own words: up to the first attribution or forward mark, without quoted lines and phone signatures."""
    t = F.coalesce(text, F.lit(""))
    marks = "|".join(f"(?:{m})" for m in _MARKS)
    head = F.regexp_replace(t, rf"(?imsd)(?:(?-s){marks})(?s:.*)\z", "")
    lines = F.filter(F.split(head, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"), lambda line: ~line.rlike(r"(?U)^\s*>"))
    t = F.array_join(lines, "\n")
    for f in _FOOTNOTES:
        t = F.regexp_replace(t, f"(?imd){f}", "")
    return strip(t)


def token_bag(query: Column) -> Column:
    """The distinct lower-case words of a query, sorted; OR is a word like others."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"(?U)\s+"), lambda w: w != "")))


#: A day or a month as it is abbreviated.
_DAY = "[A-Z][a-z]{2,8}"


def event_title(subject: Column) -> Column:
    """A calendar mail's subject without the service's prefix and date."""
    s = strip(F.coalesce(subject, F.lit("")))
    s = F.regexp_replace(s, r"(?i)^\s*(?:updated invitation:?|cancell?ed(?: event)?:|accepted:|tentative:|declined:|invitation:|reminder:)\s*", "")
    return strip(F.regexp_replace(s, rf"\s+@\s+{_DAY}\s+{_DAY}\s+\d{{1,2}},\s*\d{{4}}.*$", ""))


def is_calendar_reply(subject: Column, body: Column) -> Column:
    """A subject with one of the service's prefixes and a body with one of its marks."""
    s, b = F.lower(strip(F.coalesce(subject, F.lit("")))), F.lower(F.coalesce(body, F.lit("")))
    marks = [
        "calendar.google.com/calendar",
        "has accepted this invitation",
        "has declined this invitation",
        "has tentatively accepted this invitation",
        "invitation from google calendar",
        "you are receiving this email because " "you are subscribed to calendar",
    ]
    any_mark = F.lit(False)
    for m in marks:
        any_mark = any_mark | b.contains(m)
    return s.rlike(r"^(?:updated invitation|cancell?ed(?: event)?:|accepted:|tentative:|declined:|invitation:|reminder:)") & any_mark


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, in double precision; 0 if either is empty or null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.when((F.size(F.coalesce(a, F.array())) == 0) | (F.size(F.coalesce(b, F.array())) == 0), 0.0).otherwise(dot)


def prompt(kind: Column, label: Column) -> Column:
    """The sentence by which a label is embedded."""
    return F.when(kind == "person", F.concat(F.lit("A person named "), label, F.lit("."))).when(kind == "org", F.concat(F.lit("An organization named "), label, F.lit("."))).otherwise(label)


def snippet(text: Column, limit: int, mark: str = "") -> Column:
    """The first characters of a text, with a mark behind where it goes on."""
    t = F.coalesce(text, F.lit(""))
    cut = strip(F.substring(t, 1, limit))
    return F.when(F.length(t) > limit, F.concat(cut, F.lit(mark))).otherwise(cut)


def sentence_around(text: Column, term: Column, limit: int = 220) -> Column:
    """The sentence that holds a term as a word, cut at a word's end beyond the limit; else 80 characters on both sides of the term; else ''."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.coalesce(term, F.lit("")), lambda w: _sentence(t, w, limit)))


def _sentence(t: Column, w: Column, limit: int) -> Column:
    # the word first, then the sentence to both sides of it: a pattern of the whole sentence is tried at every character
    word = F.concat(F.lit(r"(?iuU)\b\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))

    def around(at: Column) -> Column:
        before = F.reverse(F.regexp_extract(F.reverse(F.substring(t, F.lit(1), at - 1)), r"^[^\n!.?]*", 0))
        after = F.regexp_extract(F.substring(t, at + F.length(w), F.length(t)), r"^[^\n!.?]*[!.?]?", 0)
        return F.when(at > 0, strip(F.concat(before, F.substring(t, at, F.length(w)), after)))

    def cut(s: Column) -> Column:
        head = F.substring(s, 1, limit)
        short = F.concat(F.when(head.contains(" "), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head), F.lit("..."))
        return F.when(F.length(s) > limit, short).otherwise(s)

    def window(at: Column) -> Column:
        begin = F.greatest(F.lit(1), at - 80)
        return F.when(at > 0, strip(F.substring(t, begin, at + F.length(w) + 80 - begin))).otherwise("")

    hit = let(let(F.regexp_instr(t, word), around), cut)
    return F.when(w == "", "").otherwise(F.coalesce(hit, let(F.instr(F.lower(t), F.lower(w)), window)))


def json_object(text: Column) -> Column:
    """The text itself if it is JSON, else what stands from its first { to its last }, if that is; else null."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(text).isNotNull(), text).when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


def sections(text: Column, mark: str = "###") -> Column:
    """A Markdown text cut before each heading of that rank."""
    return F.split(text, rf"(?m)(?=^{mark} )")


def freshness(hours: Column) -> Column:
    return F.when(hours < 24, "FRESH").when(hours < 168, "STALE").otherwise("OLD")


def age(hours: Column) -> Column:
    return (
        F.when(hours < 1, F.concat(F.format_string("%.0f", hours * 60), F.lit("m ago")))
        .when(hours < 24, F.concat(F.format_string("%.1f", hours), F.lit("h ago")))
        .otherwise(F.concat(F.format_string("%.1f", hours / 24), F.lit("d ago")))
    )


def file_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit(" MB")))
    )
