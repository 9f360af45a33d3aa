"""Ranks of cross-sections: few sorts, no joins of rows with themselves, and places as plain Python gives them."""

import random

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import ic


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def table(spark, n=300):
    rng = random.Random(5)
    rows = [(f"d{i % 3}", f"s{i:03}", f, float(rng.randint(0, 9)) if rng.random() < 0.9 else None, rng.choice([0.0, rng.random(), None])) for i in range(n) for f in "xyz"]
    return spark.createDataFrame(rows, "date string, symbol string, factor string, value double, label double"), rows


def test_a_rank_costs_one_sort(spark):
    df, _ = table(spark)
    plan = plan_of(df.select("date", S.average_rank("value", "date").alias("r")))
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1
    plan = plan_of(df.select("date", S.rank_percentile("value", "date").alias("r"), S.rank_percentile("label", "date").alias("q")))
    assert plan.count("Sort [") == 2 and plan.count("Exchange ") == 1


def test_places_of_a_factor_report_cost_two_sorts(spark):
    plan = plan_of(ic.ranked(table(spark)[0]))
    assert plan.count("Sort [") == 2 and plan.count("Exchange ") == 1 and "percentile" not in plan


def test_places_of_a_factor_report_equal_plain_ones(spark):
    df, rows = table(spark)
    got = {(r.date, r.factor, r.symbol): r for r in ic.ranked(df).collect()}
    assert len(got) == sum(r[3] is not None for r in rows)
    mean_place = lambda v, vs: sum(w < v for w in vs) + (sum(w == v for w in vs) + 1) / 2
    for d, f in {(r[0], r[2]) for r in rows}:
        own = [r for r in rows if (r[0], r[2]) == (d, f) and r[3] is not None]
        both = [r for r in own if r[4] is not None]
        vs, k = sorted(r[3] for r in both), max(len(both) // 5, 1)
        top = {r[1] for r in sorted(both, key=lambda r: (-r[3], r[1]))[:k]}
        bottom = {r[1] for r in sorted(both, key=lambda r: (r[3], r[1]))[:k]}
        member = {r[1] for r in sorted(own, key=lambda r: (-r[3], r[1]))[: max(len(own) // 5, 1)]}
        cuts = [(lambda p: vs[int(p)] + (vs[min(int(p) + 1, len(vs) - 1)] - vs[int(p)]) * (p - int(p)))((len(vs) - 1) * i / 5) for i in range(1, 5)]
        for r in own:
            x = got[d, f, r[1]]
            assert x.paired == (r[4] is not None) and x.member == (r[1] in member)
            if x.paired:
                assert (x.a, x.b) == (mean_place(r[3], vs), mean_place(r[4], [b[4] for b in both]))
                assert (x.top, x.bottom, x.q) == (r[1] in top, r[1] in bottom, 1 + sum(c < r[3] for c in cuts))


def test_pairs_of_factors_are_made_without_a_join(spark):
    df, _ = table(spark)
    x = ic.factor_correlation(df, 5)
    assert "Join" not in plan_of(x)
    assert {(r.factor, r.other) for r in x.collect()} == {("x", "y"), ("x", "z"), ("y", "z")}
    assert ic.factor_correlation(df.where(F.col("factor") == "x"), 5).count() == 0
