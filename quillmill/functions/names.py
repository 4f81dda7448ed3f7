"""Person names as Column expressions: cleaning, rejecting, normalising, aliases."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import vocabulary as V
from quillmill.functions.let import let

_WHITE = r"(?U)\s+"
_OWNER = r"(?U)\b([A-Z][-'A-Za-z]+)['’]s"
_END = ".,;:!?"


def words(name: Column) -> Column:
    """The words of a name, by any white space."""
    return F.filter(F.split(F.coalesce(name, F.lit("")), _WHITE), lambda w: w != "")


def _bare(word: Column) -> Column:
    return F.lower(F.trim(word, F.lit(_END)))


def _in(word: Column, entries: Iterable[str]) -> Column:
    return word.isin(sorted(entries))


def _first_kept(tokens: Column, drop) -> Column:
    """Tokens without those at the front that drop() takes."""
    def rest(ts: Column) -> Column:
        first = F.array_position(F.transform(ts, drop), F.lit(False)).cast("int")
        return F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(ts, F.greatest(first, F.lit(1)), F.size(ts)))

    return let(tokens, rest)


def _last_kept(tokens: Column, drop, least: int) -> Column:
    """Tokens without those at the end that drop() takes, but at least so many."""
    def rest(ts: Column) -> Column:
        back = F.array_position(F.reverse(F.transform(ts, drop)), F.lit(False)).cast("int")
        kept = F.when(back == 0, 0).otherwise(F.size(ts) - back + 1)
        return F.slice(ts, F.lit(1), F.greatest(kept, F.least(F.lit(least), F.size(ts))))

    return let(tokens, rest)


def clean_person(raw: Column) -> Column:
    """A name without quotes, end punctuation, leading titles and relations, and trailing roles; '' if nothing is left."""
    s = F.trim(F.trim(F.coalesce(raw, F.lit(""))), F.lit("\"'`"))
    s = F.trim(F.rtrim(s, F.lit(_END)))
    rest = _first_kept(words(s), lambda t: _in(F.lower(F.rtrim(t, F.lit("."))), V.LEADING_TITLES))
    rest = _last_kept(rest, lambda t: _in(F.lower(F.rtrim(t, F.lit(_END))), V.ROLE_TAILS), 1)
    return F.array_join(rest, " ")


def canonical_label(name: Column) -> Column:
    """A name with single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), _WHITE, " "))


def has_company_word(name: Column) -> Column:
    return F.exists(words(name), lambda w: _in(F.lower(F.trim(w, F.lit(".,"))), V.COMPANY_WORDS))


def has_kinship_word(title: Column) -> Column:
    """Whether a title has a word of kinship."""
    return F.exists(title_words(title), lambda w: _in(F.lower(w), V.KINSHIP_WORDS))


def title_words(title: Column) -> Column:
    """The words of an event's title, brackets and punctuation apart."""
    return words(F.regexp_replace(F.coalesce(title, F.lit("")), r"[()\[\]{},;:!?.]", " "))


def is_rejected(name: Column) -> Column:
    """Whether a cleaned name can't be a person's, by the first rule that fits."""
    return let(F.trim(F.coalesce(name, F.lit(""))), lambda s: let(words(s), lambda t: let(F.transform(t, _bare), lambda low: _rejected(s, t, low))))


def _rejected(s: Column, tokens: Column, lower: Column) -> Column:
    one, several = F.size(tokens) == 1, F.size(tokens) >= 2
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    solid = F.length(F.regexp_replace(s, r"(?U)\s", ""))
    first, last = F.try_element_at(lower, F.lit(1)), F.try_element_at(lower, F.lit(-1))
    cased = F.upper(s) != F.lower(s)

    def any_in(entries: Iterable[str]) -> Column:
        return F.exists(lower, lambda w: _in(w, entries))

    return (
        F.when(F.length(s) < 2, True)
        .when(one & cased & (s == F.upper(s)), True)
        .when(s.rlike("[A-Z]{4,}"), True)
        .when(s.rlike(r"\p{Nd}"), True)
        .when(letters < solid * 0.5, True)
        .when((s == F.lower(s)) & (letters > 0), True)
        .when(has_company_word(s), True)
        .when(_in(F.lower(s), V.RELATIONS), True)
        .when(F.forall(lower, lambda w: _in(w, V.COMMON_WORDS)), True)
        .when(several & (_in(first, V.ORG_EDGE_WORDS) | _in(last, V.ORG_EDGE_WORDS)), True)
        .when(any_in(V.EVENT_PLACE_WORDS), True)
        .when(several & any_in(V.SENDER_ORG_WORDS), True)
        .otherwise(_in(F.array_join(lower, " "), V.PUBLIC_NAMES))
    )


def looks_personal(name: Column) -> Column:
    """Two to four words that begin with capitals and hold no digits."""
    return let(words(name), lambda t: F.size(t).between(2, 4) & F.forall(t, lambda w: w.rlike(r"^\p{Lu}") & ~w.rlike(r"\p{Nd}")))


def sender_is_personal(name: Column) -> Column:
    """A display name that looks personal and has no word of organisations."""
    return looks_personal(name) & ~F.exists(words(name), lambda w: _in(_bare(w), V.SENDER_ORG_WORDS))


#: "as a law firm", "as the agency": the names in such a sentence are those of organisations.
ORG_CONTEXT = r"(?i)\bas\s+(?:an?|the)\s+(?:agency|attorney|company|consultancy|consulting|corporation|counsel|firm|law\s+(?:firm|office)|lawyer|llc|llp)\b"


def is_org_sentence(sentence: Column) -> Column:
    return F.coalesce(sentence.rlike(ORG_CONTEXT), F.lit(False))


def normalise(name: Column) -> Column:
    """A canonical name for headings: no word twice in a row, no roles at the end, at most three words; the name itself if nothing is left."""
    single = let(words(name), lambda ts: F.filter(ts, lambda t, i: (i == 0) | (F.lower(t) != F.lower(F.get(ts, i - 1)))))
    rest = _last_kept(single, lambda t: _in(_bare(t), V.ROLE_TAILS), 0)
    joined = let(rest, lambda r: F.array_join(F.when(F.size(r) >= 4, F.slice(r, 1, 3)).otherwise(r), " "))
    return F.coalesce(F.nullif(joined, F.lit("")), name)


def alias_tokens(name: Column) -> Column:
    """The words by which a name is compared with the user's own."""
    return words(F.lower(normalise(name)))


def matches_alias(candidate: Column, alias: Column) -> Column:
    """The rule by which two lists of words name the same person: exact, first+last or first-name; '' if none does."""
    return let(candidate, lambda c: let(alias, lambda a: _alias_rule(c, a)))


def _alias_rule(candidate: Column, alias: Column) -> Column:
    c1, a1 = F.try_element_at(candidate, F.lit(1)), F.try_element_at(alias, F.lit(1))
    both = (F.size(candidate) >= 2) & (F.size(alias) >= 2) & (F.try_element_at(candidate, F.lit(-1)) == F.try_element_at(alias, F.lit(-1)))
    return (
        F.when((F.size(candidate) == 0) | (F.size(alias) == 0), "")
        .when(candidate == alias, "exact")
        .when(both & (c1 == a1), "first+last")
        .when(((F.size(candidate) == 1) | (F.size(alias) == 1)) & (c1 == a1), "first-name")
        .otherwise("")
    )


def clean_display(raw: Column) -> Column:
    """A display name without quotes, bullets and doubled spaces; '' without an ASCII letter."""
    s = F.trim(F.trim(F.trim(F.coalesce(raw, F.lit(""))), F.lit("\"'`")), F.lit(" -\t,;:"))
    return let(s, lambda v: F.when(v.rlike("[A-Za-z]"), F.regexp_replace(v, _WHITE, " ")).otherwise(F.lit("")))


def slug(name: Column, empty: str = "unknown", limit: int | None = None) -> Column:
    """Lower-case ASCII letters and digits, with - between; a word for empty if none is left."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^0-9a-z]+", "-"), F.lit("-"))
    s = F.substring(s, 1, limit) if limit else s
    return F.when(s == "", empty).otherwise(s)


def names_in_title(title: Column) -> Column:
    """array of (name, word, detector): the persons that an event's title names, each lower-case name once, the first detector first.

    A possessive names a person; so does, in a title with a word of kinship, every other word that looks like a name.
    """
    return let(F.coalesce(title, F.lit("")), lambda t: let(title_words(t), lambda w: _title_names(t, w)))


def _title_names(t: Column, tokens: Column) -> Column:
    def person(w: Column) -> Column:
        low = F.lower(w)
        return (F.length(w) >= 2) & w.rlike(r"^\p{Lu}") & w.rlike(r"\p{Ll}") & ~_in(low, V.TITLE_STOPWORDS) & ~_in(low, V.RELATION_ONLY_WORDS)

    def rows(found: Column, word, detector: str) -> Column:
        return F.transform(found, lambda x: F.struct(x["n"].alias("name"), word(x).alias("word"), F.lit(detector).alias("detector")))

    owned = F.arrays_zip(
        F.regexp_extract_all(t, F.lit(rf"{_OWNER}\s+(\w+)"), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(rf"{_OWNER}\s+(\w+)"), F.lit(2)).alias("f")
    )
    owned = F.filter(owned, lambda x: person(x["n"]))
    bare = F.transform(F.regexp_extract_all(t, F.lit(rf"{_OWNER}\b"), F.lit(1)), lambda x: F.struct(x.alias("n")))
    bare = F.filter(bare, lambda x: person(x["n"]))
    anchor = F.try_element_at(F.filter(F.transform(tokens, F.lower), lambda w: _in(w, V.KINSHIP_WORDS)), F.lit(1))
    near = F.transform(F.filter(tokens, lambda w: ~_in(F.lower(w), V.KINSHIP_WORDS)), lambda w: F.struct(F.regexp_replace(w, r"(?<=.)['’]s$", "").alias("n")))
    near = F.when(anchor.isNotNull(), F.filter(near, lambda x: person(x["n"]))).otherwise(F.filter(near, lambda x: F.lit(False)))
    every = F.concat(
        rows(owned, lambda x: F.when(_in(F.lower(x["f"]), V.KINSHIP_WORDS), F.lower(x["f"])).otherwise(F.lit("possessive")), "possessive_in_title"),
        rows(bare, lambda x: F.lit("possessive"), "possessive_in_title"),
        rows(near, lambda x: anchor, "kinship_adjacent"),
    )
    return let(every, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: F.lower(y["name"]) == F.lower(x["name"]))))
