"""The rules of search expansion as window queries over the table of iterations.

An iteration row has run (which run it belongs to), n, parent, recap, new_messages, new_entities, new_persons, hits.
Windows are ordered by n inside a run, or inside one parent of a run.  Nothing here looks at more than one run at a
time, so that the runs of many users are judged in one shuffle by (run) or (run, parent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.vocabulary import PERSONAL_DOMAINS

HIGH_RECAP, DOWNWEIGHT, STREAK, CERTAIN_RECAP = 0.7, 0.3, 2, 0.95
SATURATED_RECAP, SATURATION_WINDOW, SATURATION_RANK = 0.75, 5, 0.8
SATURATED_SIZE, SOFT_SIZE = 50, 30
BUSINESS_RECAP, BUSINESS_DROP, BUSINESS_EXPLOSION, BUSINESS_PUSHES = 0.85, 0.7, 20, 5
BIAS_WINDOW, BIAS_POPS, BIAS_RECAP = 5, 3, 0.5
PERSON_WINDOW, PARENT_POPS, EXHAUST_WINDOW = 8, 2, 3
#: Digits to which averages, and the means of parents, are compared, so that the order of summation doesn't decide.
AVERAGE_DIGITS, MEAN_DIGITS = 6, 9
SEED, SEED_BUDGET, BUDGET, PERSONAL_BUDGET = "SEED", 5, 3, 5


def parent_domain(parent: Column) -> Column:
    """The domain of a parent that is an address, else null."""
    addr = F.lower(F.trim(F.substring(parent, 7, 1 << 20)))
    return F.when(parent.startswith("email:") & addr.contains("@"), F.substring_index(addr, "@", -1))


def is_personal_parent(parent: Column) -> Column:
    return F.coalesce(parent_domain(parent).isin(sorted(PERSONAL_DOMAINS)), F.lit(False))


def is_business_parent(parent: Column) -> Column:
    d = parent_domain(parent)
    return F.coalesce((d != "") & ~d.isin(sorted(PERSONAL_DOMAINS)), F.lit(False))


def initial_budget(parent: Column) -> Column:
    return F.when(parent == SEED, SEED_BUDGET).when(is_personal_parent(parent), PERSONAL_BUDGET).otherwise(BUDGET)


def _run(rows: int | None = None) -> Window:
    w = Window.partitionBy("run").orderBy("n")
    return w if rows is None else w.rowsBetween(1 - rows, 0)


def _parent(rows: int | None = None) -> Window:
    w = Window.partitionBy("run", "parent").orderBy("n")
    return w if rows is None else w.rowsBetween(1 - rows, 0)


def _streak(rows: DataFrame, hit: Column, name: str) -> DataFrame:
    """How many of a parent's last rows in a row are hits, up to each row."""
    breaks = F.sum((~hit).cast("int")).over(_parent())
    cut = rows.withColumn("_breaks", breaks)
    return cut.withColumn(name, F.sum(hit.cast("int")).over(Window.partitionBy("run", "parent", "_breaks").orderBy("n"))).drop("_breaks")


def parent_rules(iterations: DataFrame) -> DataFrame:
    """Iterations with what each does to its parent: factor on pending scores, whether the budget goes to 0 and by which rule, or what it loses.

    The rules in their order: streak of high recapture (at observation), then explosion, a productive iteration, dry
    business recapture, dry business streak, certain recapture, penalty; and last the business drop.
    """
    business, personal, seed = is_business_parent(F.col("parent")), is_personal_parent(F.col("parent")), F.col("parent") == SEED
    dry = F.col("new_messages") == 0
    exploded = business & (F.col("new_entities") >= BUSINESS_EXPLOSION)
    rows = _streak(iterations, dry & ~exploded, "dry_streak")
    high = F.col("recap") > HIGH_RECAP
    streak = (F.count("*").over(_parent(STREAK)) == STREAK) & (F.min("recap").over(_parent(STREAK)) > HIGH_RECAP) & ~seed
    certain = ~seed & (F.col("recap") >= CERTAIN_RECAP) & ~personal
    dropped = business & (F.col("recap") >= BUSINESS_DROP) & (F.col("new_entities") == 0)
    yield_rule = (
        F.when(exploded, "explosion")
        .when(~dry, "productive")
        .when(business & (F.col("recap") >= BUSINESS_RECAP), "business_recap")
        .when(business & (F.col("dry_streak") >= STREAK), "business_dry")
        .when(certain, "certain_recap")
        .otherwise("penalty")
    )
    penalty = F.when(yield_rule == "penalty", F.when(F.col("new_entities") == 0, 2).otherwise(1)).otherwise(0)
    return rows.select(
        "*",
        F.when(high & ~seed, DOWNWEIGHT).otherwise(1.0).alias("score_factor"),
        streak.alias("streak_prune"),
        yield_rule.alias("yield_rule"),
        penalty.alias("penalty"),
        dropped.alias("business_drop"),
        (streak | dropped | yield_rule.isin("explosion", "business_recap", "business_dry", "certain_recap")).alias("budget_zero"),
        F.greatest(F.lit(0), initial_budget(F.col("parent")) - F.sum(penalty).over(_parent())).alias("budget_after_penalties"),
    )


def run_rules(iterations: DataFrame) -> DataFrame:
    """Iterations with the state of their run: average recapture, bias towards other than business, no new persons, kind of exhaustion."""
    business = is_business_parent(F.col("parent")).cast("int")
    full = F.count("*").over(_run(SATURATION_WINDOW)) == SATURATION_WINDOW
    average = F.avg("recap").over(_run(SATURATION_WINDOW))
    near = F.round(average, AVERAGE_DIGITS)
    return iterations.select(
        "*",
        average.alias("average_recap"),
        (full & (near > SATURATED_RECAP)).alias("saturated"),
        (full & (F.sum(business).over(_run(BIAS_WINDOW)) >= BIAS_POPS) & (near > BIAS_RECAP)).alias("business_bias"),
        F.when(F.max("new_messages").over(_run(EXHAUST_WINDOW)) == 0, "frontier_exhausted_no_yield").otherwise("frontier_exhausted_clean").alias("exhausted"),
    )


def person_rules(iterations: DataFrame) -> DataFrame:
    """Iterations with hits, with: no new persons in the last ones, and whether the parent is unproductive after it."""
    rows = _streak(iterations.where("hits > 0"), F.col("new_persons") == 0, "no_person_streak")
    none = (F.count("*").over(_run(PERSON_WINDOW)) == PERSON_WINDOW) & (F.sum("new_persons").over(_run(PERSON_WINDOW)) == 0)
    exempt = (F.col("parent") == SEED) | is_personal_parent(F.col("parent"))
    return rows.select("*", none.alias("no_new_persons"), (~exempt & (F.col("no_person_streak") >= PARENT_POPS)).alias("unproductive"))


def saturated_parents(iterations: DataFrame, pending: DataFrame) -> DataFrame:
    """run, parent, mean_recap: pending parents that a saturated run prunes: those at or above the mean recapture of rank SATURATION_RANK.

    pending: run, parent, n_pending.  Only runs with more than SATURATED_SIZE pending queries and a saturated last
    iteration are judged; personal parents stay.  Parents with equal means are pruned, or stay, together.
    """
    last = run_rules(iterations).withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("n")))).where("r = 1 AND saturated").select("run")
    large = pending.groupBy("run").agg(F.sum("n_pending").alias("size")).where(F.col("size") > SATURATED_SIZE).select("run")
    means = iterations.where(F.col("parent") != SEED).groupBy("run", "parent").agg(F.avg("recap").alias("mean_recap"))
    means = means.join(pending.select("run", "parent").distinct(), ["run", "parent"], "left_semi").join(last, "run", "left_semi").join(large, "run", "left_semi")
    near = F.round("mean_recap", MEAN_DIGITS)
    ranks = means.groupBy("run").agg(F.array_sort(F.collect_list(near)).alias("all"))
    at = F.least((F.size("all") * SATURATION_RANK).cast("int"), F.size("all") - 1)
    limits = ranks.select("run", F.get("all", at).alias("limit"))
    return means.join(limits, "run").where((near >= F.col("limit")) & ~is_personal_parent(F.col("parent"))).select("run", "parent", "mean_recap")


def soft_saturated_runs(iterations: DataFrame, pending: DataFrame) -> DataFrame:
    """run: those that ask for no proposals once: more than SOFT_SIZE pending queries and a saturated last iteration."""
    last = run_rules(iterations).withColumn("r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("n")))).where("r = 1 AND saturated").select("run")
    return pending.groupBy("run").agg(F.sum("n_pending").alias("size")).where(F.col("size") > SOFT_SIZE).join(last, "run", "left_semi").select("run")


def business_saturated(iterations: DataFrame) -> DataFrame:
    """run, parent: business parents whose last recapture is at least BUSINESS_RECAP."""
    last = iterations.groupBy("run", "parent").agg(F.max_by("recap", "n").alias("recap"))
    return last.where(is_business_parent(F.col("parent")) & (F.col("recap") >= BUSINESS_RECAP)).select("run", "parent")


def admitted_business(proposals: DataFrame) -> DataFrame:
    """Proposals (run, n, place, parent, …) without those of business parents beyond BUSINESS_PUSHES in an iteration."""
    business = is_business_parent(F.col("parent"))
    r = F.row_number().over(Window.partitionBy("run", "n", business).orderBy("place"))
    return proposals.withColumn("_r", r).where(~business | (F.col("_r") <= BUSINESS_PUSHES)).drop("_r")


def pushed_score(score: Column, parent: Column) -> Column:
    """A proposal's score as it is pushed: more for personal parents, less for business ones, between 0 and 1."""
    return F.when(is_personal_parent(parent), F.least(F.lit(1.0), score + 0.25)).when(is_business_parent(parent), F.greatest(F.lit(0.0), score - 0.35)).otherwise(score)


def iteration_cap_label(size: Column, executed: Column, rejected: Column) -> Column:
    return (
        F.when((executed > 0) & (rejected > executed * 0.5), "iter_cap_throttled").when(size > 7, "iter_cap_uncontrolled").when(size < 5, "iter_cap_almost_done").otherwise("iter_cap")
    )


def stop_reason(state: DataFrame, max_tokens: int = 500_000, max_chars: int = 50 << 20, max_iterations: int = 25) -> DataFrame:
    """state rows (run, tokens, chars, size, exhausted, no_new_persons, iteration, executed, rejected) with stop, null where a run goes on."""
    return state.withColumn(
        "stop",
        F.when(F.col("tokens") >= max_tokens, "budget_cap")
        .when(F.col("chars") >= max_chars, "corpus_cap")
        .when(F.col("size") == 0, F.col("exhausted"))
        .when(F.col("no_new_persons"), "no_new_persons_after_N")
        .when(F.col("iteration") >= max_iterations, iteration_cap_label(F.col("size"), F.col("executed"), F.col("rejected"))),
    )
