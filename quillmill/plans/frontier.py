"""The frontier of one run: pending queries, budgets and stop rules.

A run has some tens of pending queries, and whether one is admitted depends on those before it; this is state of the
driver, not of the cluster.  The same rules over the recorded iterations of many runs are in operators.rules.
"""

from __future__ import annotations

import difflib
import heapq
from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass, field

from quillmill.functions.vocabulary import PERSONAL_DOMAINS
from quillmill.operators import rules as R


def _domain(parent: str) -> str | None:
    addr = parent[6:].strip().lower() if parent.startswith("email:") else ""
    return addr.rsplit("@", 1)[1] if "@" in addr else None


def personal(parent: str) -> bool:
    return _domain(parent) in PERSONAL_DOMAINS


def business(parent: str) -> bool:
    return bool(_domain(parent)) and not personal(parent)


@dataclass
class Pending:
    """A query that waits; order is (-score, place) at the time it was last moved."""

    query: str
    score: float
    parent: str
    why: str
    place: int

    def __lt__(self, other: Pending) -> bool:
        return (-self.score, self.place) < (-other.score, other.place)


@dataclass(frozen=True)
class Stop:
    rule: str
    detail: str


@dataclass
class Frontier:
    """embed: unit vectors of queries, by which near ones are dropped; without it their characters are compared."""

    embed: Callable[[str], list[float]] | None = None
    max_iterations: int = 25
    max_tokens: int = 500_000
    max_chars: int = 50 << 20
    pending: list[Pending] = field(default_factory=list)
    ran: list[str] = field(default_factory=list)
    budgets: dict[str, int] = field(default_factory=dict)
    history: dict[str, list[float]] = field(default_factory=lambda: defaultdict(list))
    counts: dict[str, int] = field(default_factory=lambda: defaultdict(int))

    def __post_init__(self) -> None:
        self._recaps: deque[float] = deque(maxlen=R.SATURATION_WINDOW)
        self._business_pops: deque[bool] = deque(maxlen=R.BIAS_WINDOW)
        self._persons: deque[int] = deque(maxlen=R.PERSON_WINDOW)
        self._yields: deque[int] = deque(maxlen=R.EXHAUST_WINDOW)
        self._dry: dict[str, int] = defaultdict(int)
        self._fruitless: dict[str, int] = defaultdict(int)
        self._vectors: list[list[float]] = []
        self._places = self._business_pushes = 0
        self._skip = False

    def __len__(self) -> int:
        return len(self.pending)

    def __bool__(self) -> bool:
        return True  # an empty frontier is a frontier

    def begin_iteration(self) -> None:
        self._business_pushes = 0

    def start_budget(self, parent: str) -> int:
        return R.SEED_BUDGET if parent == R.SEED else R.PERSONAL_BUDGET if personal(parent) else R.BUDGET

    def has_budget(self, parent: str) -> bool:
        return bool(parent) and self.budgets.get(parent, self.start_budget(parent)) > 0

    def unproductive(self, parent: str) -> bool:
        return bool(parent) and parent != R.SEED and not personal(parent) and self._fruitless[parent] >= R.PARENT_POPS

    def business_saturated(self, parent: str, recap: float | None = None) -> bool:
        past = self.history.get(parent)
        last = recap if recap is not None else past[-1] if past else 0.0
        return business(parent) and last >= R.BUSINESS_RECAP

    @staticmethod
    def bag(query: str) -> frozenset[str]:
        return frozenset(query.lower().split())

    def push(self, query: str, score: float = 1, parent: str = "", why: str = "") -> bool:
        """Whether the query was admitted; a query that belongs to no parent is an error."""
        if not isinstance(parent, str) or not parent.strip():
            raise ValueError("a query needs a parent, or nothing would bound it")
        text = query.strip().lower()
        if not text:
            return False
        if personal(parent):
            score = min(1.0, score + 0.25)
        elif business(parent):
            if self._business_pushes >= R.BUSINESS_PUSHES:
                self.counts["business_cap"] += 1
                return False
            score = max(0.0, score - 0.35)
        if self.budgets.setdefault(parent, self.start_budget(parent)) <= 0:
            self.counts["no_budget"] += 1
            return False
        if self.unproductive(parent):
            self.counts["unproductive"] += 1
            return False
        if self._known(text):
            self.counts["known"] += 1
            return False
        self.budgets[parent] -= 1
        self._business_pushes += business(parent)
        self._places += 1
        heapq.heappush(self.pending, Pending(query, score, parent, why, self._places))
        return True

    def _known(self, text: str) -> bool:
        bag = self.bag(text)
        if any(self.bag(q) == bag for q in self.ran) or any(self.bag(p.query) == bag for p in self.pending):
            return True
        if self.embed:
            own = self.embed(text)
            return any(sum(x * y for x, y in zip(own, v, strict=True)) >= 0.92 for v in self._vectors)
        return any(difflib.SequenceMatcher(None, text, q).ratio() >= 0.80 for q in [*self.ran, *(p.query.lower() for p in self.pending)])

    def push_many(self, proposals) -> int:
        return sum(self.push(**p) for p in proposals)

    def pop(self) -> Pending | None:
        """The best pending query; after many fruitless business queries the first of another kind, as the heap lies."""
        if not self.pending:
            return None
        at = 0
        if len(self._business_pops) == R.BIAS_WINDOW == len(self._recaps) and sum(self._business_pops) >= R.BIAS_POPS and round(sum(self._recaps) / R.BIAS_WINDOW, R.AVERAGE_DIGITS) > R.BIAS_RECAP:
            at = next((i for i, p in enumerate(self.pending) if not business(p.parent)), 0)
        if at:
            best = self.pending.pop(at)
            heapq.heapify(self.pending)
        else:
            best = heapq.heappop(self.pending)
        self._business_pops.append(business(best.parent))
        return best

    def mark_ran(self, query: str) -> None:
        text = query.strip().lower()
        self.ran.append(text)
        if self.embed:
            self._vectors.append(self.embed(text))

    def observe_recapture(self, parent: str, recap: float) -> None:
        self._recaps.append(recap)
        if parent != R.SEED:
            past = self.history[parent]
            past.append(recap)
            if recap > R.HIGH_RECAP:
                for p in self.pending:
                    if p.parent == parent:
                        p.score *= R.DOWNWEIGHT
                heapq.heapify(self.pending)
            if len(past) >= R.STREAK and min(past[-R.STREAK :]) > R.HIGH_RECAP and self.budgets.get(parent, 0) > 0:
                self.budgets[parent] = 0
        full = len(self._recaps) == R.SATURATION_WINDOW and round(sum(self._recaps) / R.SATURATION_WINDOW, R.AVERAGE_DIGITS) > R.SATURATED_RECAP
        if full and len(self.pending) > R.SATURATED_SIZE:
            self._prune_saturated()
        if full and len(self.pending) > R.SOFT_SIZE:
            self._skip = True

    def _prune_saturated(self) -> None:
        means = {p: round(sum(h) / len(h), R.MEAN_DIGITS) for p in {x.parent for x in self.pending} if (h := self.history.get(p))}
        if means:
            ranked = sorted(means.values())
            limit = ranked[min(int(R.SATURATION_RANK * len(ranked)), len(ranked) - 1)]
            for p, mean in means.items():
                if mean >= limit and self.budgets.get(p, 0) > 0 and not personal(p):
                    self.budgets[p] = 0
                    self.counts["saturated"] += 1

    def observe_yield(self, parent: str, new_messages: int, new_entities: int) -> int:
        """The parent's budget after an iteration brought so much."""
        if parent not in self.budgets:
            return 0
        last = self.history[parent][-1] if self.history.get(parent) else None
        if business(parent) and new_entities >= R.BUSINESS_EXPLOSION:
            self.pending = [p for p in self.pending if p.parent != parent]
            heapq.heapify(self.pending)
            self._dry[parent] = self.budgets[parent] = 0
        elif new_messages > 0:
            self._dry[parent] = 0
        else:
            self._dry[parent] += 1
            worn = business(parent) and ((last is not None and last >= R.BUSINESS_RECAP) or self._dry[parent] >= R.STREAK)
            if worn or (last is not None and last >= R.CERTAIN_RECAP and not personal(parent)):
                self.budgets[parent] = 0
            else:
                self.budgets[parent] = max(0, self.budgets[parent] - (2 if new_entities == 0 else 1))
        return self.budgets[parent]

    def drop_business(self, parent: str, recap: float, new_entities: int) -> bool:
        """Takes budget and score from a business parent that brings nothing new."""
        if not business(parent) or recap < R.BUSINESS_DROP or new_entities:
            return False
        mine = [p for p in self.pending if p.parent == parent and p.score]
        acted = bool(mine) or self.budgets.get(parent, 0) > 0
        if self.budgets.get(parent, 0) > 0:
            self.budgets[parent] = 0
        for p in mine:
            p.score = 0.0
        heapq.heapify(self.pending)
        return acted

    def observe_iteration(self, new_messages: int) -> None:
        self._yields.append(new_messages)

    def observe_persons(self, parent: str, new_persons: int) -> None:
        self._persons.append(max(0, new_persons))
        if parent != R.SEED:
            self._fruitless[parent] = 0 if new_persons > 0 else self._fruitless[parent] + 1

    def take_skip(self) -> bool:
        """Whether this iteration asks for no proposals; true once for each time the run was saturated."""
        skip, self._skip = self._skip, False
        self.counts["skipped"] += skip
        return skip

    def exhausted(self) -> Stop:
        dry = bool(self._yields) and not any(self._yields)
        return Stop("frontier_exhausted_no_yield" if dry else "frontier_exhausted_clean", f"no pending queries; new messages lately: {list(self._yields)}")

    def stop(self, iteration: int, tokens: int, chars: int) -> Stop | None:
        size, executed = len(self.pending), len(self.ran)
        if tokens >= self.max_tokens:
            return Stop("budget_cap", f"{tokens} tokens of {self.max_tokens}")
        if chars >= self.max_chars:
            return Stop("corpus_cap", f"{chars} characters of {self.max_chars}")
        if not size:
            return self.exhausted()
        if len(self._persons) == R.PERSON_WINDOW and not any(self._persons):
            return Stop("no_new_persons_after_N", f"{R.PERSON_WINDOW} iterations without a new person; {size} pending")
        if iteration < self.max_iterations:
            return None
        rejected = self.counts["no_budget"]
        label = "_throttled" if executed and rejected > executed * 0.5 else "_uncontrolled" if size > 7 else "_almost_done" if size < 5 else ""
        return Stop("iter_cap" + label, f"{iteration} iterations; {size} pending, {executed} executed, {rejected} rejected")

    def report(self, stop: Stop, iterations: int, proposed: int, top: int = 10) -> list[str]:
        """Lines that say how the run ended; the largest budgets last."""
        recap = f"{sum(self._recaps) / len(self._recaps):.2f}" if self._recaps else "n/a"
        lines = [
            f"stop: {stop.rule} ({stop.detail})", f"iterations: {iterations}", f"queries: {len(self.ran)} executed, {proposed} proposed, {len(self.pending)} pending",
            f"rejected: {', '.join(f'{k} {v}' for k, v in sorted(self.counts.items())) or 'none'}", f"average recapture: {recap}", f"persons lately: {list(self._persons)}", "budgets:",
        ]
        return lines + [f"  {p}: {b}" for p, b in sorted(self.budgets.items(), key=lambda x: (-x[1], x[0]))[:top]]
