"""Search expansion: search, extract, decide what to search next, stop, and describe what was found.

The driver holds the frontier and the counts of an iteration; messages and entities are tables.  What a round adds
is written as a Parquet part of the run's folder and read from there, so that lineage doesn't grow with the rounds
and nothing is lost with an executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import without_quotes
from quillmill.operators import canonical as C
from quillmill.operators import corpus as K
from quillmill.operators import entities as E
from quillmill.plans.frontier import Frontier, Stop
from quillmill.plans.proposer import Proposal, expansion_queries, seed_queries
from quillmill.plans.search import search

ITERATION = (
    "n int, query string, score double, hits bigint, new_messages bigint, new_entities bigint, frontier_after int, recapture double, "
    "parent string, pushed int, bulk bigint, new_persons bigint"
)


@dataclass
class Result:
    """What a run found: tables, the iterations as rows, and why it ended."""

    corpus: DataFrame
    entities: DataFrame
    canonical: DataFrame
    iterations: list[tuple]
    stop: Stop
    queries: list[str]
    report: list[str] = field(default_factory=list)

    def iteration_table(self) -> DataFrame:
        return self.corpus.sparkSession.createDataFrame(self.iterations, ITERATION)


def shared_folder(spark) -> str:
    """The folder that all executors share; only a local session may name none, and gets one of its own."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmill-")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def expand(
    messages: DataFrame,
    seed: str,
    frontier: Frontier | None = None,
    recogniser: E.Recogniser = E.capitalised_spans,
    vectors: Callable[[DataFrame], DataFrame] | None = None,
    propose_seeds: Callable[[str], list[Proposal]] = seed_queries,
    propose: Callable[[list[tuple[str, str]], list[str]], list[Proposal]] = expansion_queries,
    on_iteration: Callable[[tuple], None] = lambda row: None,
) -> Result:
    """Runs until the frontier stops it.

    messages: the mailbox; vectors: gives kind, label, vector for a table of kind, label (names stay apart without).
    """
    spark, folder = messages.sparkSession, _folder(messages.sparkSession)
    frontier = Frontier() if frontier is None else frontier
    seeds = propose_seeds(seed)
    proposed = len(seeds)
    for p in seeds:
        frontier.push(p.query, p.score, p.parent, p.why)

    mail_path, entity_path = f"{folder}/corpus", f"{folder}/entities"
    mail_schema, entity_schema = messages.schema, "message_id string, kind string, key string, label string, confidence string"
    messages.limit(0).write.parquet(mail_path)
    spark.createDataFrame([], entity_schema).write.parquet(entity_path)
    corpus = lambda: spark.read.schema(mail_schema).parquet(mail_path)
    found = lambda: spark.read.schema(entity_schema).parquet(entity_path)

    rows: list[tuple] = []
    n = chars = 0
    while True:
        n += 1
        frontier.begin_iteration()
        stop = frontier.stop(n - 1, 0, chars)
        query = None if stop else frontier.pop()
        if query is None:
            stop = stop or frontier.exhausted()
            break
        frontier.mark_ran(query.query)
        hits = search(messages, query.query)
        n_hits = hits.count()
        part = f"{folder}/new-{n:04d}"
        fresh = K.new_messages(corpus(), hits).withColumn("body_clean", F.coalesce("body_clean", without_quotes(F.col("body"))))
        fresh.write.parquet(part)
        fresh = spark.read.schema(mail_schema).parquet(part)
        size = K.sizes(fresh).first()
        before = E.distinct_entities(found()).persist()
        delta_path = f"{folder}/delta-{n:04d}"
        E.extract_delta(fresh, fresh, recogniser).write.parquet(delta_path)
        delta = spark.read.schema(entity_schema).parquet(delta_path)
        n_delta, n_known = E.distinct_entities(delta).count(), E.recaptured(delta, before).count()
        new = E.new_entities(delta, before)
        labels = before.union(E.distinct_entities(delta)).select("kind", "label").distinct()
        names = C.canonical_map(vectors(labels)) if vectors else C.identity_map(labels)
        kept = [(r["kind"], r["label"]) for r in E.by_canonical(new, names).orderBy("kind", "key").collect()]
        before.unpersist()
        fresh.write.mode("append").parquet(mail_path)
        delta.write.mode("append").parquet(entity_path)

        chars += size["n_chars"]
        n_new, persons = size["n_messages"], sum(kind == "person" for kind, _ in kept)
        # a search without hits counts as one that brought nothing new
        recap = max(n_known / max(n_delta, 1), (max(n_hits, 1) - n_new) / max(n_hits, 1))
        frontier.observe_recapture(query.parent, recap)
        frontier.observe_yield(query.parent, n_new, len(kept))
        frontier.drop_business(query.parent, recap, len(kept))
        frontier.observe_iteration(n_new)
        if n_hits:
            frontier.observe_persons(query.parent, persons)
        offered = [e for e in kept if frontier.has_budget(name := ":".join(e)) and not frontier.business_saturated(name) and not frontier.unproductive(name)]
        if frontier.business_saturated(query.parent, recap):
            offered = []
        if frontier.take_skip():
            offered = []
        proposals = propose(offered, frontier.ran) if offered else []
        proposed += len(proposals)
        pushed = sum(frontier.push(p.query, p.score, p.parent, p.why) for p in proposals)
        row = (n, query.query, query.score, n_hits, n_new, len(kept), len(frontier), recap, query.parent, pushed, size["n_bulk"], persons)
        rows.append(row)
        on_iteration(row)
        if stop := frontier.stop(n, 0, chars):
            break
    labels = E.distinct_entities(found()).select("kind", "label")
    names = C.canonical_map(vectors(labels)) if vectors else C.identity_map(labels)
    return Result(corpus(), found(), names, rows, stop, list(frontier.ran), frontier.report(stop, len(rows), proposed))
