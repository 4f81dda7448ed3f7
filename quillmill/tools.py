"""What an agent or a command line asks for, as thin functions over tables."""

from __future__ import annotations

import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import age, file_size, freshness, snippet
from quillmill.operators import candidates as C
from quillmill.plans.expansion import Result, expand
from quillmill.plans.search import search
from quillmill.sources import profile as P
from quillmill.sources.schema import clean_text

SHOWN, BODY = 50, 10_000


def search_messages(messages: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """message_id, source_account, from_addr, date, subject, snippet of up to 50 messages; accounts share the limit equally."""
    capped = min(max(1, limit), SHOWN)
    hits = search(messages, query)
    accounts = [r[0] for r in messages.select("source_account").distinct().limit(SHOWN + 1).collect()]
    share = max(1, capped // len(accounts)) if len(accounts) > 1 else capped
    parts = [hits.where(F.col("source_account") == a).orderBy("message_id").limit(share) for a in sorted(accounts)] or [hits.limit(0)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    text = F.translate(clean_text(), "\n", " ")
    return out.select("message_id", "source_account", "from_addr", "date", "subject", snippet(text, 200, "...").alias("snippet"))


def read_message(messages: DataFrame, message_id: str) -> DataFrame:
    """One message, its body cut at 10,000 characters with a note; of accounts that share an id the first by name."""
    text = clean_text()
    body = F.when(F.length(text) > BODY, F.concat(F.substring(text, 1, BODY), F.format_string("\n[truncated — full message is %d chars]", F.length(text)))).otherwise(text)
    return messages.where(F.col("message_id") == message_id).orderBy("source_account").limit(1).select("message_id", "thread_id", "source_account", "from_addr", "to_addr", "date", "subject", body.alias("body"))


def build_profile(messages: DataFrame, query: str, folder: str, email: str | None = None, display_name: str | None = None, status: str | None = None, **options) -> tuple[Result, str]:
    """Runs an expansion and writes its profile; the status file, if one is named, says how far it is."""
    say = (lambda **s: P.write_status(status, query=query, **s)) if status else (lambda **s: None)
    say(state="running", iterations=0)
    try:
        result = expand(messages, query, on_iteration=lambda row: say(state="running", iterations=row[0]), **options)
        members = get_candidates(result, email, display_name)
        path = P.write_profile(P.profile_document(members, result.corpus, query, result.stop.rule, result.queries), folder, query)
    except Exception as e:
        say(state="failed", error=str(e)[:500])
        raise
    say(state="done", iterations=len(result.iterations), path=path)
    return result, path


def get_candidates(result: Result, email: str | None = None, display_name: str | None = None) -> DataFrame:
    """The members that a run's profile shows, without the user."""
    own = {e for e in ((email or "").strip().lower(),) if e}
    own |= {f"{e.split('@')[0].split('+')[0]}@{e.split('@', 1)[1]}" for e in own if "@" in e}
    best = C.ranked(result.corpus, result.entities, result.canonical, own)
    cited = C.excerpts(best, result.corpus)
    if email or display_name:
        cited = C.without_self(cited, C.self_aliases(result.corpus, display_name, email))
    return C.profile_members(cited)


def who_is(profiles: DataFrame, person: str) -> DataFrame:
    return P.person_sections(profiles, person).select("name", "section")


def about_me(profiles: DataFrame, topic: str = "overview") -> DataFrame:
    return P.overview(profiles) if topic.lower() == "overview" else P.topic_sections(profiles, topic).select("name", F.col("section").alias("text"))


def profile_health(profiles: DataFrame, now: float | None = None) -> DataFrame:
    """name, n_members, freshness, age, size."""
    hours = (F.lit(time.time() if now is None else now) - F.col("modified").cast("double")) / 3600
    return profiles.join(P.member_counts(profiles), "name").select("name", "n_members", freshness(hours).alias("freshness"), age(hours).alias("age"), file_size(F.col("size")).alias("size"))


def build_status(path: str) -> dict | None:
    return P.read_status(path)


def reset_profiles(folder: str, others: Iterable[str] = (), confirm: bool = False) -> list[str]:
    """The files that a reset removes; they are removed only if confirm is set."""
    paths = [*sorted(str(p) for p in Path(folder).glob("*.md")), *(o for o in others if Path(o).exists())]
    if confirm:
        for p in paths:
            Path(p).unlink(missing_ok=True)
    return paths


def open_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return P.read_profiles(spark, folder)
