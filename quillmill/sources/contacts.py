"""Contacts and groups from an address book's JSON, and their family signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.vocabulary import BIOGRAPHY_WORDS
from quillmill.sources.remote import LIST_UNITS, Metrics, call

STARRED, FAMILY = "contactGroups/starred", "contactGroups/family"
PERSON = (
    "resourceName string, names array<struct<displayName:string,givenName:string,familyName:string>>, emailAddresses array<struct<value:string>>, "
    "memberships array<struct<contactGroupMembership:struct<contactGroupResourceName:string>>>, relations array<struct<person:string,type:string,formattedType:string>>, "
    "biographies array<struct<value:string>>"
)
GROUP = "resourceName string, name string, formattedName string, memberCount int, groupType string"


PAGE = 1000


def list_contacts(service, metrics: Metrics) -> list[dict]:
    """All contacts of a service whose list_page(size, token) gives a page of persons and the next one's token or None."""
    out, token = [], None
    while True:
        page, token = call(lambda: service.list_page(PAGE, token), metrics, LIST_UNITS)
        out += page
        if not token:
            return out


def _clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _list(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def contacts(raw: DataFrame) -> DataFrame:
    """Contacts from a column of JSON persons (json) with their order (seq); persons without id, or without name and address, are left out."""
    p = raw.select("seq", F.from_json("json", PERSON).alias("p")).select("seq", "p.*")
    first = F.try_element_at("names", F.lit(1))
    emails = F.array_distinct(F.filter(F.transform(_list("emailAddresses", "array<struct<value:string>>"), lambda e: F.lower(_clean(e["value"]))), lambda e: e != ""))
    groups = F.filter(F.transform("memberships", lambda m: _clean(m["contactGroupMembership"]["contactGroupResourceName"])), lambda g: g != "")
    relations = F.transform("relations", lambda r: F.struct(_clean(r["person"]).alias("person"), _clean(r["type"]).alias("type"), _clean(r["formattedType"]).alias("formatted_type")))
    rows = p.select(
        "seq", _clean(F.col("resourceName")).alias("resource_name"), _clean(first["displayName"]).alias("display"), F.nullif(_clean(first["givenName"]), F.lit("")).alias("given_name"),
        F.nullif(_clean(first["familyName"]), F.lit("")).alias("family_name"), emails.alias("emails"), F.coalesce(groups, F.array().cast("array<string>")).alias("memberships"),
        F.coalesce(F.filter(relations, lambda r: (r["person"] != "") | (r["type"] != "")), F.array().cast("array<struct<person:string,type:string,formatted_type:string>>")).alias("relations"),
        F.nullif(_clean(F.try_element_at("biographies", F.lit(1))["value"]), F.lit("")).alias("biography"),
    ).where("resource_name <> '' AND (display <> '' OR size(emails) > 0)")
    parts = F.concat_ws(" ", "given_name", "family_name")
    name = F.when(F.col("display") != "", F.col("display")).when(parts != "", parts).otherwise(F.substring_index(F.try_element_at("emails", F.lit(1)), "@", 1))
    return rows.withColumn("display_name", name).drop("display").withColumn("is_starred", F.array_contains("memberships", STARRED))


def groups(raw: DataFrame) -> DataFrame:
    g = raw.select(F.from_json("json", GROUP).alias("g")).select("g.*")
    return g.select(
        _clean(F.col("resourceName")).alias("resource_name"), _clean(F.col("name")).alias("name"), F.coalesce(F.nullif(_clean(F.col("formattedName")), F.lit("")), _clean(F.col("name"))).alias("formatted_name"),
        F.coalesce("memberCount", F.lit(0)).alias("member_count"), (_clean(F.col("groupType")) == "SYSTEM_CONTACT_GROUP").alias("is_system"),
    )


def family_group(all_groups: DataFrame) -> DataFrame:
    """No row or one: the system's family group if it has members, else the largest with the word family and none of business."""
    tokens = F.split(F.lower("formatted_name"), r"[\s\-_]+")
    system = (F.col("resource_name") == FAMILY) & (F.col("member_count") > 0)
    named = F.array_contains(tokens, "family") & ~F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ("business", "fund", "funds", "office")]))
    return all_groups.where(system | named).orderBy(F.desc(system), F.desc("member_count"), "resource_name").limit(1)


def signals(rows: DataFrame, family_resource: str | None = None, surname: str | None = None) -> DataFrame:
    """Contacts with strength, the greatest of their signals, and source, the names of all, joined by +."""
    words = "|".join(sorted(BIOGRAPHY_WORDS, key=lambda w: (-len(w), w)))
    rules = [
        (F.array_contains("memberships", family_resource) if family_resource else F.lit(False), 1.0, "group_membership"),
        (F.size("relations") > 0, 0.90, "relations_field"),
        (F.coalesce(F.col("biography").rlike(rf"(?iU)\b(?:{words})\b"), F.lit(False)), 0.75, "biography"),
        (F.coalesce(F.lower(F.trim("family_name")) == (surname or "").strip().lower(), F.lit(False)) if (surname or "").strip() else F.lit(False), 0.70, "surname"),
        (F.col("is_starred"), 0.55, "starred"),
    ]
    return rows.select("*", F.greatest(F.lit(0.0), *[F.when(c, s).otherwise(0.0) for c, s, _ in rules]).alias("strength"), F.concat_ws("+", *[F.when(c, n) for c, _, n in rules]).alias("source"))


def family_members(rows: DataFrame) -> DataFrame:
    """Contacts with any signal, strongest first, then by name."""
    return rows.where("strength > 0").orderBy(F.desc("strength"), "display_name")
