"""Exact selection against sorted lists: ties, heavy tails, tiny brackets, groups with nulls."""

import math
import random

import pytest

from tessera.operators import quantiles

QS = (0.0, 0.05, 0.5, 0.95, 0.999, 1.0)


def exact(values, q):
    x, k = sorted(values), (len(values) - 1) * q
    a = x[min(int(k), len(x) - 1)]
    return a if k == int(k) else a + (x[int(k) + 1] - a) * (k - int(k))


@pytest.mark.parametrize("few", [40, 100_000])
def test_quantiles_of_groups(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "ACCURACY", 10)  # wide brackets, so that they are narrowed in rounds
    rng = random.Random(few)
    groups = {
        "ties": [0.0] * 700 + [rng.choice([-1.0, 1.0, 2.0]) for _ in range(300)], "tail": [10.0 ** rng.uniform(-30, 30) * rng.choice([-1, 1]) for _ in range(1500)], "plain": [rng.gauss(0, 1) for _ in range(1201)],
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 400, None: [float(i) for i in range(150)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("plain", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, "v", QS, ("g",), few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        for i, q in enumerate(QS):
            assert math.isclose(got[g][f"q{i}"], exact(vs, q), rel_tol=1e-12, abs_tol=1e-12), (g, q)


def test_quantiles_of_a_whole_table(spark):
    df = spark.range(20_001).selectExpr("cast((id * 7919) % 20001 as double) as v")
    row = quantiles.exact_quantiles(df, "v", (0.25, 0.999)).first()
    assert tuple(row) == (20_001, 5000.0, 19_980.0)
    assert "percentile(" not in quantiles.exact_quantiles(df, "v", (0.5,))._jdf.queryExecution().toString()
    assert tuple(quantiles.exact_quantiles(df.limit(0), "v", (0.5,)).first()) == (0, None)
    assert quantiles.exact_quantiles(df.limit(0).selectExpr("v", "1 as g"), "v", (0.5,), ("g",)).count() == 0
