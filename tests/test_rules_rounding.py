"""Averages and means that differ only by the order of summation."""

from functools import reduce
from operator import add

from quillmill.operators import rules as R
from quillmill.plans.frontier import Frontier

KIND = "run int, n int, parent string, recap double, new_messages int, new_entities int, new_persons int, hits int"


def test_average_at_the_limit_is_not_above_it(spark):
    lasts = [0.65, 0.66, 0.62, 0.89, 0.93]  # 3.75, which summed in this order and divided is 0.7500000000000001
    recaps = [0.8] * 60 + lasts
    rows = [(1, n, "person:A", r, 1, 1, 0, 1) for n, r in enumerate(recaps)]
    df = spark.createDataFrame(rows, KIND)
    assert not R.run_rules(df).where("n = 64").first()["saturated"]
    pending = df.groupBy("run", "parent").count().withColumnRenamed("count", "n_pending")
    assert R.saturated_parents(df, pending).count() == 0 and R.soft_saturated_runs(df, pending).count() == 0
    f = Frontier()
    f._recaps.extend(lasts[:4])
    for k in range(R.SOFT_SIZE + 1):
        f.push(f"q{k}", 1.0, "person:A")
    f.observe_recapture("person:A", lasts[4])
    assert not f._skip


def test_equal_means_go_together(spark):
    a = [0.8, 0.9, 0.7, 0.1] * 10
    b = sorted(a)  # alike, but for the order of summation
    assert reduce(add, a) != reduce(add, b)
    rows = [(1, n, p, r, 1, 1, 0, 1) for p, rs, at in (("person:A", a, 0), ("person:B", b, 100)) for n, r in enumerate(rs, at)]
    rows += [(1, 200 + n, "SEED", 1.0, 1, 1, 0, 1) for n in range(5)]
    df = spark.createDataFrame(rows, KIND).coalesce(1)
    pending = df.groupBy("run", "parent").count().withColumnRenamed("count", "n_pending")
    assert sorted(r["parent"] for r in R.saturated_parents(df, pending).collect()) == ["person:A", "person:B"]
