"""A deterministic judge of family relations, and a reader for the verdicts of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.names import words
from quillmill.functions.vocabulary import JUDGE_RELATIONS

_CLASSES = {
    "spouse": "fiance fiancee husband partner spouse wife",
    "parent": "dad daddy father ma mom mommy mother mum pa papa stepdad stepmom",
    "sibling": "bro brother sibling siblings sis sister",
    "child": "baby child children daughter kid kids son",
    "grandparent": "grandfather grandma grandmother grandpa nana",
    "grandchild": "grandchild granddaughter grandkids grandson",
    "aunt_or_uncle": "aunt auntie uncle",
    "cousin": "cousin",
    "niece_or_nephew": "nephew niece",
}
DECISIONS = ["family", "not_family", "uncertain"]


def relation_class(word: Column) -> Column:
    out = F.when(F.coalesce(word, F.lit("")) == "", F.lit(None).cast("string"))
    for name, entries in _CLASSES.items():
        out = out.when(F.lower(word).isin(entries.split()), name)
    return out.otherwise("other")


def relation_before(text: Column, name: Column) -> Column:
    """The word of relation that stands before a person's first name, after my, your or nothing; '' if none does."""
    first = F.lower(F.try_element_at(words(name), F.lit(1)))
    relations = "|".join(sorted(JUDGE_RELATIONS, key=lambda w: (-len(w), w)))
    quoted = F.concat(F.lit(r"\Q"), F.replace(first, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b"))
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.regexp_extract(F.regexp_substr(low, F.concat(F.lit(rf"(?U)\b{lead}(?:{relations})\s+"), quoted)), rf"({relations})\s+\S+$", 1) for lead in (r"my\s+", r"your\s+", "")]
    return F.when(first.isNull(), "").otherwise(F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit("")))


def judged(candidates: DataFrame, surname: str | None = None, contacts_known: bool = False) -> DataFrame:
    """Candidates with decision, relation_guess, confidence.

    candidates: canonical, texts (array of excerpts), contact (struct of strength, in_family_group, relations; null
    without one).  Strong contact signals first, then the user's surname, then a word of relation before the name, then
    weak contact signals.  contacts_known: the user keeps contacts, so that missing there costs 0.1.
    """
    tokens = words(F.col("canonical"))
    c = F.col("contact")
    strong = F.coalesce(c["in_family_group"] | (c["strength"] >= 0.85), F.lit(False))
    weak = F.coalesce(c["strength"] > 0, F.lit(False))
    found = F.try_element_at(F.filter(F.transform("texts", lambda t: relation_before(t, F.col("canonical"))), lambda r: r != ""), F.lit(1))
    named = (F.size(tokens) >= 2) & (F.lower(F.try_element_at(tokens, F.lit(-1))) == (surname or "").strip().lower()) if (surname or "").strip() else F.lit(False)
    less = F.when(c.isNull() & F.lit(contacts_known), 0.1).otherwise(0.0)
    kin = F.coalesce(F.try_element_at(F.array_compact(F.transform(c["relations"], lambda r: relation_class(F.lower(F.trim(F.substring_index(r, ":", 1)))))), F.lit(1)), F.lit("other"))
    return candidates.select(
        "*",
        F.when(strong | named | found.isNotNull(), "family").when(weak, "uncertain").otherwise("not_family").alias("decision"),
        F.when(strong, kin).when(named, "other").when(found.isNotNull(), relation_class(found)).alias("relation_guess"),
        F.round(F.when(strong, F.greatest(F.lit(0.95), c["strength"])).when(named, 0.85 - less).when(found.isNotNull(), 0.70 - less).when(weak, c["strength"]).otherwise(0.5), 4).alias("confidence"),
    )


def read_verdicts(answers: DataFrame) -> DataFrame:
    """Verdicts in JSON answers (json): null where the decision is none; confidence between 0 and 1, 0.5 if it isn't a number."""
    v = F.from_json("json", "decision string, relation_guess string, confidence string, reasoning string")
    decision = F.lower(F.trim(v["decision"]))
    verdict = F.struct(
        decision.alias("decision"), F.nullif(F.trim(v["relation_guess"]), F.lit("")).alias("relation_guess"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["confidence"].try_cast("double"), F.lit(0.5)))).alias("confidence"), F.trim(F.coalesce(v["reasoning"], F.lit(""))).alias("reasoning"),
    )
    return answers.withColumn("verdict", F.when(decision.isin(DECISIONS), verdict))
