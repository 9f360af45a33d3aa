"""States without recursions, folds, metrics, hypothesis batches and features against plain Python."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pit, quality, relational, research, statistics, windows

DAY = datetime.date(2024, 1, 1)


def day(k):
    return DAY + datetime.timedelta(k)


@pytest.mark.parametrize(("enter", "leave"), [(1, 1), (2, 3), (3, 2), (5, 5)])
def test_confirmed_states_equal_those_day_by_day(spark, enter, leave):
    rng, rows, want = random.Random(enter * 10 + leave), [], {}
    for s in range(8):
        raws = [rng.choice(["risk"] * 3 + ["normal", "caution", "unknown", None]) for _ in range(60)]
        rows += [(s, day(k), r) for k, r in enumerate(raws)]
        states = statistics.regimes(raws, enter, leave)
        want |= {(s, day(k)): r for k, r in enumerate(states)}
    got = statistics.hysteresis(spark.createDataFrame(rows, "strategy_id int, date date, raw string"), enter, leave)
    assert {(r.strategy_id, r.date): r.regime for r in got.collect()} == want


def test_gate_parameters():
    rows = statistics.one_at_a_time()
    assert len(rows) == 25 and len({r[0] for r in rows}) == 25 and all(len(r) == 8 for r in rows)
    drawn = statistics.sampled()
    assert 100 < len(drawn) <= 200 and drawn == statistics.sampled() and all(r[5] <= r[6] for r in drawn) and len({r[3:] for r in drawn}) == len(drawn)


@pytest.mark.parametrize(("n", "k", "paths"), [(6, 2, 5), (8, 2, 7), (6, 1, 1), (10, 3, 36), (4, 2, 3), (12, 4, 165)])
def test_cpcv_paths(n, k, paths):
    assert statistics.cpcv_paths(n, k) == paths == math.comb(n - 1, k - 1)


def slow_roles(n, test, t0, t1, embargo):
    last, out = max(test), {}
    for i in range(n):
        if i in test:
            out[i] = "test"
        elif any(t0[i] <= t1[j] and t1[i] >= t0[j] for j in test):
            out[i] = "purged"
        else:
            out[i] = "embargo" if last < i <= last + math.floor(n * embargo) else "train"
    return out


def test_folds_and_combinations_against_brute_force(spark):
    import itertools

    n = 23
    t0, t1 = [day(k) for k in range(n)], [day(k + k % 3) for k in range(n)]
    df = spark.createDataFrame([(i, t0[i], t1[i]) for i in range(n)], "i int, t0 date, t1 date")
    blocks = [x.tolist() for x in np.array_split(np.arange(n), 6)]
    got = {(r.combo, r.i): (r.role, r.block) for r in statistics.cpcv(df, 6, 2, 0.1).collect()}
    own = {i: b for b, x in enumerate(blocks) for i in x}
    for c, chosen in enumerate(itertools.combinations(range(6), 2)):
        roles = slow_roles(n, {i for b in chosen for i in blocks[b]}, t0, t1, 0.1)
        assert all(got[c, i] == (roles[i], own[i]) for i in range(n))
    assert len(got) == 15 * n
    folds = {(r.fold, r.i): r.role for r in statistics.purged_folds(df, 5, 0.1).collect()}
    for f, test in enumerate(np.array_split(np.arange(n), 5)):
        roles = slow_roles(n, set(test.tolist()), t0, t1, 0.1)
        assert all(folds[f, i] == roles[i] for i in range(n))
    with pytest.raises(ValueError):
        statistics.cpcv(df, 4, 4)


def test_metric_of_cscv_is_pluggable(spark):
    rng = random.Random(1)
    rows = [(b, c, rng.gauss(0.02 * (c == 3), 0.01)) for b in range(6) for c in range(5) for _ in range(10)]
    df = spark.createDataFrame(rows, "block int, config int, ret double")
    sharpe = lambda r: F.when(F.var_samp(r) > 1e-18, F.avg(r) / F.stddev_samp(r)).otherwise(0.0)
    a, b = statistics.cscv_pbo(df, 6).first(), statistics.cscv_pbo(df, 6, sharpe).first()
    assert a.combos == b.combos == 20 and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b))
    assert statistics.cscv_pbo(df, 6, F.median).first().pbo == 0.0


def panel(spark):
    rng = random.Random(5)
    rows = [(day(k), f"s{j}", x, rng.random(), 0.8 * x + 0.2 * rng.random(), 1.0) for k in range(12) for j in range(20) for x in [rng.random()]]
    return spark.createDataFrame(rows, "date date, symbol string, good double, noise double, label double, fwd_1 double")


def test_rejected_hypotheses_never_reach_the_evaluator(spark):
    H = research.Hypothesis
    seen = []

    def evaluator(long):
        seen.append({r.factor for r in long.select("factor").distinct().collect()})
        return long.groupBy("factor").agg((F.corr("value", "label") > 0.5).alias("passed"))

    bad = [H("late", "fwd_1", ("fwd_1",)), H("unknown", "nowhere", ("nowhere",)), H("label", "label", ("label",)), H("wrong", "-good", ("good",), 1)]
    got = {r.factor: r for r in research.validate_batch(panel(spark), bad, evaluator).collect()}
    assert seen == [] and {k: v.stage for k, v in got.items()} == {"late": "lint_rejected", "unknown": "lint_rejected", "label": "lint_rejected", "wrong": "evidence_rejected"}
    assert "direction" in got["wrong"].reasons and "looks ahead" in got["late"].reasons
    good = [H("good", "good * 2", ("good",)), H("minus", "-good", ("good",), -1)]
    got = {r.factor: (r.stage, r.status) for r in research.validate_batch(panel(spark), bad + good, evaluator).collect()}
    assert seen == [{"good", "minus"}] and got["good"] == ("return_evaluated", "verified") and got["minus"] == ("return_evaluated", "falsified") and len(got) == 6
    assert {r.stage for r in research.validate_batch(panel(spark), good).collect()} == {"evidence_passed"}


def test_daily_evaluator_sees_days_of_what_passed(spark):
    rows = [(f, day(t), float(i), float(i * sign + t % 2)) for f, sign in (("up", 1), ("down", -1)) for t in range(6) for i in range(8)] + [("up", day(9), 1.0, -100.0), ("up", day(3), None, -100.0)]
    long = spark.createDataFrame(rows, "factor string, date date, value double, label double")
    judge = research.daily_evaluator(lambda v, y: float(np.cov(v, y)[0, 1]))
    assert {(r["factor"], r["days"], r["passed"]) for r in judge(long).collect()} == {("up", 6, True), ("down", 6, False)}
    assert judge(long.limit(0)).count() == 0


def slow_haar(x, levels=3):
    a, details = np.array(x, float), []
    for _ in range(levels):
        if len(a) < 2:
            break
        h = len(a) // 2 * 2
        details.append((a[:h:2] - a[1:h:2]) / 2)
        a = (a[:h:2] + a[1:h:2]) / 2

    def spread(c):
        out = np.zeros(len(x))
        out[np.arange(len(c)) * (len(x) // len(c))] = c
        return out

    e = float((np.array(x) ** 2).sum()) + 1e-10
    return spread(a)[-1], spread(details[0])[-1], float((a**2).sum()) / e, float((details[0] ** 2).sum()) / e, math.log1p(e)


def test_haar_features(spark):
    rng = random.Random(2)
    series = {"long": [rng.random() for _ in range(70)], "short": [rng.random() for _ in range(7)], "two": [1.0, 3.0], "one": [2.0]}
    df = spark.createDataFrame([(s, day(k), v) for s, x in series.items() for k, v in enumerate(x)], "symbol string, date date, close double")
    got = {(r.symbol, r.date): tuple(r)[2:] for r in windows.haar_features(df).collect()}
    for s, x in series.items():
        for k in range(len(x)):
            part = x[k - 59 : k + 1] if k >= 59 else x if len(x) < 60 and k == len(x) - 1 and len(x) >= 2 else None
            assert got[s, day(k)] == pytest.approx(slow_haar(part) if part else (0, 0, 0, 0, 0), abs=1e-9)


def test_long_ledgers_stream_by(spark):
    import hashlib

    rows = [(f"l{k % 2}", k, f"p{k}") for k in range(30_000)]
    got = {(r.ledger, r.seq): (r.prev, r.hash) for r in quality.build_chain(spark.createDataFrame(rows, "ledger string, seq long, payload string").repartition(7)).collect()}
    for l in ("l0", "l1"):
        prev = ""
        for _, seq, payload in (r for r in rows if r[0] == l):
            have, prev = prev, hashlib.sha256(f"{prev}|{payload}".encode()).hexdigest()
            assert got[l, seq] == (have, prev)


def test_year_ago_keeps_gaps(spark):
    q = [datetime.date(2020, 3, 31), datetime.date(2020, 6, 30), datetime.date(2021, 3, 31), datetime.date(2022, 3, 31)]
    df = spark.createDataFrame([("a", q[0], 1.0, 10.0), ("a", q[1], 2.0, 20.0), ("a", q[2], 4.0, None), ("a", q[3], 8.0, 5.0), ("b", q[2], 3.0, 3.0)], "symbol string, period date, x double, y double")
    got = {(r.symbol, r.period): (r.dx, r.dy) for r in pit.year_ago(df, {"x": "dx", "y": "dy"}).collect()}
    assert got == {("a", q[0]): (None, None), ("a", q[1]): (None, None), ("a", q[2]): (3.0, None), ("a", q[3]): (4.0, None), ("b", q[2]): (None, None)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def whole_plan(query, monkeypatch):
    """The plans of a query and of all tables that it writes while it is built, counted together."""
    from tessera.sources import scratch

    plans, write = [], scratch.written
    with monkeypatch.context() as m:
        m.setattr(scratch, "written", lambda df: plans.append(plan_of(df)) or write(df))
        plans.append(plan_of(query()))
    reads = sum(p.count("FileScan") for p in plans) - sum("panel-" in line for p in plans for line in p.splitlines() if "FileScan" in line)
    return reads, sum(p.count("Exchange") for p in plans)


def test_plans_read_each_table_once(spark, sf_dir, tmp_path, monkeypatch):
    from tessera.plans import registry

    pit_plan = plan_of(registry.QUERIES["j04_pit_join"](spark, sf_dir))
    assert pit_plan.count("FileScan") <= 3
    reads, exchanges = whole_plan(lambda: registry.QUERIES["b01_factor_report"](spark, sf_dir), monkeypatch)
    print("b01", reads, exchanges)
    assert reads <= 4 and exchanges <= 24
    ics = plan_of(registry.QUERIES["w21_rank_ic"](spark, sf_dir))
    assert ics.count("FileScan") == 1
    # a filter by a literal reaches the scan
    path = str(tmp_path / "t")
    spark.createDataFrame([(day(k), k) for k in range(100)], "date date, v int").write.parquet(path)
    recent = relational.recent_window(spark.read.parquet(path), 5)
    assert "GreaterThanOrEqual(date" in plan_of(recent) and recent.count() == 6
    assert relational.recent_window(spark.read.parquet(path).limit(0), 5).count() == 0
    assert "GreaterThanOrEqual(l_shipdate" in plan_of(registry.QUERIES["s02_recent_window"](spark, sf_dir))


def test_ranks_of_large_groups_equal_those_of_one_task(spark):
    from tessera.operators import ic

    rng = random.Random(6)
    rows = [("f" if k % 4 else "g", float(rng.randint(0, 60)), rng.random() if k % 50 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "factor string, value double, label double")
    a, b = ({r.factor: r for r in f(df, ["factor"]).collect()} for f in (ic.rank_ic, ic.whole_rank_ic))
    assert a.keys() == b.keys() and all(a[k].n == b[k].n and a[k].status == b[k].status and a[k].ic == pytest.approx(b[k].ic, abs=1e-12) for k in a)
    assert ic.whole_rank_ic(df.limit(0), ["factor"]).count() == 0
