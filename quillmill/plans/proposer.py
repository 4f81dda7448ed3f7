"""Which queries to try: a deterministic proposer, and readers for the answers of others."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from quillmill.functions.vocabulary import MOCK_SEED_STOPWORDS
from quillmill.operators.rules import SEED


@dataclass(frozen=True)
class Proposal:
    query: str
    score: float
    why: str
    parent: str


def seed_queries(seed: str, limit: int = 3) -> list[Proposal]:
    """All telling words of a seed together, then each in subjects."""
    telling = filter(lambda w: len(w) > 1 and w not in MOCK_SEED_STOPWORDS, seed.lower().split())
    words = list(telling) or [seed.strip()]
    out = [Proposal(" OR ".join(words), 0.9, "all words of the seed", SEED)] if len(words) > 1 else []
    return (out + [Proposal(f"subject:{w}", 0.7, "a word of the seed", SEED) for w in words])[:limit]


def expansion_queries(entities: list[tuple[str, str]], ran: Iterable[str], limit: int = 3) -> list[Proposal]:
    """For the last entities (kind, label) the query that looks for each: a person's first name, an address as sender."""
    known, out = {q.strip().lower() for q in ran}, []
    for kind, label in reversed(entities):
        query, score = {"person": (label.split()[0], 0.7), "email": (f"from:{label}", 0.6), "relation": (label, 0.5)}.get(kind, (label, 0.4))
        if query.lower() not in known and len(out) < limit:
            out.append(Proposal(query, score, f"about {label}", f"{kind}:{label}"))
    return out


def read_json(text: str) -> dict | None:
    """The JSON object in an answer: the answer itself, or what stands from its first { to its last }."""
    for part in (text, text[max(0, text.find("{")) : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        return found
    return None


def read_proposals(data: dict | None, offered: set[str] | None = None, limit: int = 3) -> list[Proposal]:
    """Proposals in an answer.  Without offered parents they are seeds; else those with another parent are dropped."""
    out = []
    data = data if isinstance(data, dict) else {}
    for p in next((data[k] for k in ("proposals", "queries") if data.get(k)), ()):
        query, parent = str(p.get("query") or "").strip(), str(p.get("parent_entity") or "").strip()
        if not query or (offered is not None and parent not in offered):
            continue
        try:
            score = float(p.get("score", 0.8 if offered is None else 0.7))
        except (TypeError, ValueError):
            score = 0.8 if offered is None else 0.7
        out.append(Proposal(query, score, str(p.get("justification") or ""), parent or SEED))
    return out[:limit]
