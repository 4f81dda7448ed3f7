"""Profiles as Markdown documents, what is read back from them, and status files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.address import HOST
from quillmill.functions.names import slug
from quillmill.functions.text import sections
from quillmill.operators.candidates import footnotes
from quillmill.operators.corpus import fingerprint, source_accounts


def _scalar(x) -> str:
    return json.dumps(x, ensure_ascii=False)


def _yaml(value, indent: str = "") -> list[str]:
    out = []
    for k, v in value.items():
        if isinstance(v, dict):
            out += [f"{indent}{k}:", *_yaml(v, indent + "  ")]
        elif isinstance(v, (list, tuple)):
            out += [f"{indent}{k}:" if v else f"{indent}{k}: []", *(f"{indent}- {_scalar(x)}" for x in v)]
        else:
            out.append(f"{indent}{k}: {_scalar(v)}")
    return out


def query_slug(query: str) -> str:
    s = "-".join(re.findall("[0-9a-z]+", (query or "").lower()))
    return s[:50] or "profile"


def profile_document(members: DataFrame, messages: DataFrame, seed: str, stop_reason: str, queries: Iterable[str], derived: str | None = None) -> str:
    """A profile's text.  members are those of operators.candidates.profile_members: as many as a profile shows, which the driver can hold."""
    rows = members.select("*", slug(F.col("name")).alias("slug")).collect()
    notes = footnotes(members).orderBy("name", "i").collect()
    accounts = sorted(r[0] for r in source_accounts(messages).collect())
    several = len(accounts) > 1

    def tag(account: str | None) -> str:
        return f"[{account}] " if several and account else ""

    name, title = query_slug(seed), seed or "Query results"
    front = {
        "schema_version": 1, "kind": name, "canonical_name": title, "query": seed, "profile_slug": name,
        "members": [f"[[people/{s}]]" for s in dict.fromkeys(r["slug"] for r in rows)], "aliases": [name], "last_derived": derived or datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "source_fingerprint": fingerprint(messages).first()[0], "source_messages": messages.count(), "candidates": len(rows), "confidence": "low" if len(rows) < 3 else "medium",
        "derivation": dict(seed=seed, stop_reason=stop_reason, queries_run=list(queries)),
    } | ({"accounts": accounts} if several else {})
    body = ["# Candidates", "", f'Everyone found in the messages; whom the query "{seed}" means is for the reader to judge.', ""]
    if not rows:
        body += ["(nobody was found)", ""]
    for r in rows:
        body += [f"### {r['name']}", "", f"- Appears in {r['n_messages']} messages"]
        body += [f"- {label}: yes" for label, c in (("Bidirectional correspondence", "bidirectional"), ("Personal-domain contact", "personal_domain"), ("Calendar signal", "calendar")) if r[c]]
        host = re.search(f"@({HOST})", r["excerpts"][0]["from_addr"] or "")
        body += [f"- Domain: {host[1]}"] if host else []
        body += ["- Evidence:", *(f'  - {tag(n["source_account"])}"{n["excerpt"]}" [^{n["number"]}]' for n in notes if n["name"] == r["name"]), ""]
    cited = {n["number"]: n for n in notes}
    body += ["## Open questions", "", "- People who share a first name aren't told apart.", "", "## Provenance", ""]
    body += [f'[^{k}]: {tag(n["source_account"])}gmail:{n["message_id"]} - "{n["subject"] or ""}"' for k, n in sorted(cited.items())]
    return "\n".join(["---", *_yaml(front), "---", "", *body, ""])


def write_profile(document: str, folder: str, seed: str) -> str:
    """Writes a profile below folder, over an earlier one of the same query, and returns its path."""
    path = Path(folder) / f"{query_slug(seed)}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(document, encoding="utf-8")
    return str(path.resolve())


def write_status(file: str, /, **status) -> None:
    """Replaces a status file at once: readers see the old one or the new one."""
    part = f"{file}.part"
    Path(file).parent.mkdir(parents=True, exist_ok=True)
    Path(part).write_text(json.dumps(status), encoding="utf-8")
    os.replace(part, file)


def read_status(path: str) -> dict | None:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def read_profiles(spark, folder: str) -> DataFrame:
    """name, modified, size, text of the profiles in a folder."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def latest(profiles: DataFrame) -> DataFrame:
    """The profile that was written last, if there is any."""
    return profiles.orderBy(F.desc("modified"), F.desc("name")).limit(1)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def profile_sections(profiles: DataFrame, mark: str = "###") -> DataFrame:
    """name, place, header, body, section: the parts of profiles, cut before each heading of that rank."""
    rows = profiles.select("name", F.posexplode(sections(F.col("text"), mark)).alias("place", "raw")).select("name", "place", _trimmed(F.col("raw")).alias("section"))
    head = F.substring_index("section", "\n", 1)
    body = F.when(F.instr("section", "\n") > 0, F.regexp_extract("section", r"(?s)^[^\n]*\n(.*)$", 1)).otherwise("")
    return rows.where("section <> ''").select("name", "place", F.trim(F.ltrim(head, F.lit("#"))).alias("header"), body.alias("body"), "section")


def person_sections(profiles: DataFrame, person: str) -> DataFrame:
    """The sections of persons that mention a name, in heading or text; none for an empty name."""
    needle = person.strip().lower()
    rows = profile_sections(profiles).where(F.col("section").startswith("### "))
    return rows.where((F.lower("header").contains(needle) | F.lower("body").contains(needle)) if needle else F.lit(False))


def topic_sections(profiles: DataFrame, topic: str, limit: int = 2000) -> DataFrame:
    """The sections that mention a topic; if there is none, the chapters that do, cut at limit."""
    if not (needle := topic.lower().strip()):
        return profile_sections(profiles).limit(0)
    fine = profile_sections(profiles).where(F.lower("section").contains(needle))
    coarse = profile_sections(profiles, "##").where(F.lower("section").contains(needle))
    cut = F.when(F.length("section") > limit, F.concat(F.substring("section", 1, limit), F.lit("\n... (truncated)"))).otherwise(F.col("section"))
    none = fine.agg(F.count("*").alias("n")).where("n = 0")
    return fine.unionByName(coarse.withColumn("section", cut).join(none.select(), how="cross"))


def overview(profiles: DataFrame) -> DataFrame:
    """name, text: each profile's front matter and what comes up to its second chapter."""
    return profiles.select("name", F.regexp_extract("text", r"(?s)\A(.*?\n## .*?)(?=\n## |\z)", 1).alias("head"), "text").select("name", F.when(F.col("head") != "", F.col("head")).otherwise(F.col("text")).alias("text"))


def member_counts(profiles: DataFrame) -> DataFrame:
    """name, n_members: headings of persons in each profile."""
    return profiles.select("name", F.size(F.regexp_extract_all("text", F.lit(r"(?m)^### \S"), F.lit(0))).alias("n_members"))


def members_of(profiles: DataFrame) -> DataFrame:
    """name, member: the persons that a profile's front matter links to, as names."""
    links = F.regexp_extract_all("text", F.lit(r"\[\[people/([a-z0-9-]+)\]\]"), F.lit(1))
    return profiles.select("name", F.explode(links).alias("slug")).select("name", F.initcap(F.replace("slug", F.lit("-"), F.lit(" "))).alias("member"))
