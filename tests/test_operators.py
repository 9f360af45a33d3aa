"""Small fixtures, ties and nulls, closed forms against loops, and tests that the future can't change the past."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import ic, pit, quality, statistics, windows, xsec
from tessera.operators import portfolio as B
from tessera.operators import relational as R
from tessera.sources import panels, stores


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def panel(spark, symbols=4, days=70, seed=1, cut=None):
    rng = random.Random(seed)
    rows = []
    for s in range(symbols):
        p = 10.0
        for k in range(days):
            chg = None if k == 0 else rng.uniform(-5, 5) if cut is None or k <= cut else 99.0 * rng.random()
            p = p if chg is None else p * (1 + chg / 100)
            rows.append((f"{s:06d}", day(k), p * 0.99, p * 1.02, p * 0.97, p, float(rng.randint(1, 99)), chg, rng.random()))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, change_pct double, turnover double")


def frame(df, *order):
    return df.orderBy(*order).toPandas()


@pytest.mark.parametrize("name", ["factor_scores", "factor_values", "kdj", "trend_score", "symbolic_state", "cross_trend", "technical"])
def test_future_rows_change_no_past_row(spark, name):
    """Rows after day 40 differ; all rows up to it stay."""
    rng = np.random.default_rng(3)
    a = panel(spark)
    b = a.withColumn("close", F.when(F.col("date") > F.lit(day(40)), F.col("close") * 3).otherwise(F.col("close"))).withColumn("change_pct", F.when(F.col("date") > F.lit(day(40)), F.lit(float(rng.random()))).otherwise(F.col("change_pct")))
    op = getattr(windows, name)
    x, y = (frame(op(t).where(F.col("date") <= F.lit(day(40))), "symbol", "date") for t in (a, b))
    pd.testing.assert_frame_equal(x, y)


def test_pit_join_sees_no_later_report(spark):
    left = spark.createDataFrame([("a", day(k)) for k in (0, 5, 9, 20)] + [("b", day(5))], "symbol string, date date")
    reports = [("a", day(5), 1, 1.0), ("a", day(5), 2, 2.0), ("a", day(9), 0, None), ("c", day(1), 1, 9.0), ("a", None, 3, 8.0)]
    right = spark.createDataFrame(reports, "symbol string, avail date, period int, roe double")
    got = {(r.symbol, r.date): (r.period, r.roe) for r in pit.asof(left, right, "symbol", "date", "avail", ["period"]).collect()}
    assert got == {("a", day(0)): (None, None), ("a", day(5)): (2, 2.0), ("a", day(9)): (0, None), ("a", day(20)): (0, None), ("b", day(5)): (None, None)}
    later = right.union(spark.createDataFrame([("a", day(6), 5, 7.0)], right.schema))
    again = {(r.symbol, r.date): (r.period, r.roe) for r in pit.asof(left, later, "symbol", "date", "avail", ["period"]).where(F.col("date") <= F.lit(day(5))).collect()}
    assert again == {k: v for k, v in got.items() if k[1] <= day(5)}


def test_checked_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    good = spark.createDataFrame([("a", 5.0)], "k string, p double")
    assert sorted(map(tuple, pit.checked_left_join(left, good, ["k"], {"v": "p"}).collect())) == [("a", 5.0), ("b", 2.0)]
    with pytest.raises(Exception, match="repeats a key"):
        pit.checked_left_join(left, good.union(good), ["k"], {"v": "p"}).collect()


def test_average_ranks_with_ties_and_nulls(spark):
    vals = [3.0, 1.0, 3.0, None, 2.0, 1.0]
    df = spark.createDataFrame([(1, v) for v in vals] + [(2, 7.0), (3, None)], "d int, v double")
    got = sorted(((r.d, r.v, r.r, r.p, r.q) for r in df.select("d", "v", S.average_rank("v", "d").alias("r"), S.rank_percentile("v", "d").alias("p"), S.cs_rank("v", "d").alias("q")).collect()), key=repr)
    s = pd.Series(vals)
    want = sorted([(1, v, None if v is None else r, 0.5 if v is None else (r - 1) / 4, None if v is None else r / 5) for v, r in zip(vals, s.rank())] + [(2, 7.0, 1.0, 0.5, 1.0), (3, None, None, 0.5, None)], key=repr)
    assert got == want


def test_rank_ic_statuses(spark):
    rows = [("a", i, float(i), float(i * i)) for i in range(6)] + [("b", i, 1.0, float(i)) for i in range(6)] + [("c", 0, 1.0, 2.0), ("d", 0, None, 2.0)]
    got = {r.day: (r.n, r.status, r.ic) for r in ic.rank_ic(spark.createDataFrame(rows, "day string, symbol int, value double, label double"), ["day"], least=5).collect()}
    assert got["a"][:2] == (6, "settled") and got["a"][2] == pytest.approx(1) and got["b"] == (6, "constant_rank", None) and got["c"] == (1, "insufficient_pairs", None) and "d" not in got


def test_neutralize_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    n = 60
    ind, size = rng.integers(0, 4, n), rng.normal(10, 1, n)
    y = ind * 0.5 + size * 0.3 + rng.normal(0, 1, n)
    df = spark.createDataFrame([(day(0), f"{i:06d}", int(ind[i]), float(size[i]), float(y[i])) for i in range(n)], "date date, symbol string, industry int, ln_size double, f double")
    got = frame(xsec.neutralize(df, ["f"]), "symbol")["z_f"].to_numpy()
    w = np.clip(y, *np.quantile(y, [0.01, 0.99]))
    x = np.column_stack([size, *[(ind == k).astype(float) for k in range(4)]])
    r = w - x @ np.linalg.lstsq(x, w, rcond=None)[0]
    np.testing.assert_allclose(got, (r - r.mean()) / r.std(), atol=1e-9)
    assert frame(xsec.neutralize(df.limit(20), ["f"]), "symbol")["z_f"].isna().all()


def test_kdj_and_cusum_closed_forms(spark):
    df = panel(spark, 1, 40)
    p = frame(df, "date")
    got = frame(windows.kdj(df), "date")
    lo, hi = p["low"].rolling(9, min_periods=1).min(), p["high"].rolling(9, min_periods=1).max()
    rsv = (p["close"] - lo) / (hi - lo) * 100
    for t in range(16, 40):
        k = d = 50.0
        for v in rsv[t - 8 : t + 1]:
            k = k * 2 / 3 + v / 3
            d = d * 2 / 3 + k / 3
        assert got["k"][t] == pytest.approx(k) and got["d"][t] == pytest.approx(d)
    assert got["k"][:16].isna().all()
    series = df.select(F.lit("x").alias("indicator"), "date", F.col("turnover").alias("value"))
    c = frame(statistics.cusum(series), "date")
    v = p["turnover"]
    m, s, up, down = v.mean(), v.std(), 0.0, 0.0
    for t in range(40):
        up, down = max(0, up + v[t] - m - 0.5 * s), max(0, down + m - v[t] - 0.5 * s)
        assert c["cusum_up"][t] == pytest.approx(up, abs=1e-9) and c["cusum_down"][t] == pytest.approx(down, abs=1e-9)


def test_adjusted_close_anchors_at_the_last_row(spark):
    rows = [("a", day(k), c, p) for k, (c, p) in enumerate([(10.0, None), (11.0, 10.0), (10.45, -5.0), (5.2, None), (5.72, 10.0)])]
    got = frame(windows.adjusted_close(spark.createDataFrame(rows, "symbol string, date date, close double, change_pct double")), "date")["adj_close"]
    np.testing.assert_allclose(got[::-1], [5.72, 5.2, 5.2, 5.2 / 0.95, 5.2 / 0.95 / 1.1])


def test_forward_labels_need_exact_sessions(spark):
    cal = spark.createDataFrame([(day(k), k) for k in range(5)], "date date, idx int")
    bars = spark.createDataFrame([("a", day(k), 1.0) for k in range(5)] + [("b", day(0), 1.0), ("b", day(2), 1.0), ("c", day(0), 1.0), ("c", day(1), -100.0)], "symbol string, date date, change_pct double")
    got = {(r.symbol, r.date, r.horizon): (r.valid, r.reason) for r in windows.exact_labels(bars, cal, (1,)).collect()}
    assert got[("a", day(0), 1)] == (True, None) and got[("a", day(4), 1)] == (False, "not_mature") and got[("b", day(0), 1)] == (False, "missing_future_bar") and got[("c", day(0), 1)] == (False, "invalid_change_pct")


def test_technical_equals_recursion(spark):
    df = panel(spark, 1, 30)
    p, got = frame(df, "date"), frame(windows.technical(df), "date")
    d = p["close"].diff()
    up = down = None
    for t in range(1, 30):
        u, v = max(d[t], 0), max(-d[t], 0)
        up, down = (u, v) if up is None else (up + (u - up) / 14, down + (v - down) / 14)
        if down > 0:
            assert got["rsi"][t] == pytest.approx(100 - 100 / (1 + up / down))


def test_pbo_of_skill_and_noise(spark):
    rng = np.random.default_rng(5)

    def pbo(edge):
        rows = [(b, c, float(rng.normal(edge if c == 0 else 0, 0.01))) for b in range(8) for c in range(9) for _ in range(25)]
        return statistics.cscv_pbo(spark.createDataFrame(rows, "block int, config int, ret double")).first()

    skilled = pbo(0.01)
    assert skilled.combos == math.comb(8, 4) and skilled.pbo == 0 and skilled.lambda_mean > 1.5
    assert pbo(0.0).pbo > 0.1


def test_gate_regimes():
    raw = ["risk", "risk", "normal", "risk", "risk", "risk", "unknown", "normal", "caution", "normal", "normal"]
    assert statistics.regimes(raw, 3, 3) == ["caution", "caution", "normal", "caution", "caution", "risk", "unknown", "risk", "risk", "normal", "normal"]


def test_normal_distribution(spark):
    from statistics import NormalDist

    xs = [-6.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.96, 5.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(statistics.normal_cdf(F.col("x")).alias("p")).collect()]
    np.testing.assert_allclose(got, [NormalDist().cdf(x) for x in xs], atol=2e-7)


def test_report_availability_and_codes(spark):
    df = spark.createDataFrame([(dt.date(2020, 12, 31),), (dt.date(2020, 3, 31),), (dt.date(2020, 6, 30),), (dt.date(2020, 9, 30),), (dt.date(2020, 5, 31),)], "p date")
    assert [r.a for r in df.select(S.available_on("p").alias("a")).collect()] == [dt.date(2021, 4, 30), dt.date(2020, 4, 30), dt.date(2020, 8, 31), dt.date(2020, 10, 31), dt.date(2020, 12, 31)]
    codes = spark.createDataFrame([("600519.SH",), ("1",), ("830799",), ("abc",), (None,)], "c string")
    assert [tuple(r) for r in codes.select(S.canonical_code("c"), S.suffixed_code("c")).collect()] == [("600519", "600519.SH"), ("000001", "000001.SZ"), ("830799", "830799.BJ"), ("abc", "abc.SZ"), (None, None)]
    nums = spark.createDataFrame([("1.04亿",), ("5833万",), ("-",), ("",), (None,), ("12.5",)], "n string")
    assert [r.v for r in nums.select(S.number_with_unit("n").alias("v")).collect()] == [pytest.approx(1.04e8), pytest.approx(5.833e7), None, None, None, 12.5]


def test_universe_keeps_the_unknown(spark):
    rows = [
        ("000001", "ok", None, None, None), ("000002", "*ST x", False, dt.date(2000, 1, 1), 100.0), ("000003", "ok", True, dt.date(2000, 1, 1), 100.0), ("000004", "ok", False, dt.date(2024, 1, 1), 100.0),
        ("000005", "ok", False, dt.date(2000, 1, 1), 10.0), ("000006", "ok", False, dt.date(2000, 1, 1), 100.0), ("900001", "ok", False, dt.date(2000, 1, 1), 100.0),
    ]
    df = spark.createDataFrame([(*r, 1.0, 1.0) for r in rows], "symbol string, name string, is_st boolean, list_date date, float_cap double, turnover double, amount double")
    assert sorted(r.symbol for r in R.filter_universe(df, "2024-02-01", ["000"]).collect()) == ["000001", "000006"]


def test_stores(spark, tmp_path):
    a = spark.createDataFrame([("x", day(0), 1), ("x", day(1), 2)], "symbol string, date date, v int")
    path = str(tmp_path / "t")
    assert stores.append_days(a, path) == 2
    assert stores.append_days(a.union(spark.createDataFrame([("y", day(2), 3), ("y", day(-1), 9)], a.schema)), path) == 1
    assert stores.append_absent(spark.createDataFrame([("x", day(0), 7), ("z", day(0), 7)], a.schema), path, ["symbol", "date"]) == 1
    assert spark.read.parquet(path).count() == 4
    got = stores.upsert(a, spark.createDataFrame([("x", day(1), 5, 1), ("x", day(1), 6, 2), ("n", day(3), 8, 1)], "symbol string, date date, v int, __order int"), ["symbol", "date"])
    assert sorted(map(tuple, got.collect())) == [("n", day(3), 8), ("x", day(0), 1), ("x", day(1), 6)]
    days = str(tmp_path / "d")
    stores.replace_days(a, days)
    stores.replace_days(spark.createDataFrame([("q", day(1), 4)], a.schema), days)
    assert sorted((r.symbol, r.v) for r in spark.read.parquet(days).collect()) == [("q", 4), ("x", 1)]
    stores.write_version(a, str(tmp_path / "v"), "one")
    assert stores.read_version(spark, str(tmp_path / "v"), "one").count() == 2
    a.drop("v").write.parquet(str(tmp_path / "m/old"))
    a.write.parquet(str(tmp_path / "m/new"))
    assert stores.read_merged(spark, [str(tmp_path / "m/old"), str(tmp_path / "m/new")], {"symbol": "string", "v": "int", "w": "double"}).where("v is null and w is null").count() == 2
    (tmp_path / "l.jsonl").write_text('{"seq": 1, "x": "a"}\nnot json\n{"seq": 2}\n')
    good, bad = stores.read_ledger(spark, str(tmp_path / "l.jsonl"), "seq long, x string")
    assert sorted(r.seq for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    assert {r["view"]: r["rows"] for r in stores.write_views({"a": a}, str(tmp_path / "views")).collect()} == {"a": 2}


def test_ledger_and_manifest(spark, tmp_path):
    import hashlib

    chain = quality.build_chain(spark.createDataFrame([("l", k, f"p{k}") for k in range(1, 6)], "ledger string, seq long, payload string"))
    assert quality.verify_chain(chain, 5).first().broken == 0 and quality.verify_chain(chain, 6).first().broken == 1
    hurt = chain.where("seq != 3")
    assert quality.verify_chain(hurt).first().first_bad == 4
    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(n)
    manifest = spark.createDataFrame([("a", hashlib.sha256(b"a").hexdigest()), ("b", "0"), ("z", "0")], "name string, sha256 string")
    assert {r.name: r.status for r in quality.verify_manifest(spark, str(tmp_path), manifest).collect()} == {"a": "ok", "b": "changed", "z": "missing", "c": "extra"}
    assert quality.backfill_plan("2024-01-01", "2024-01-09", "2024-01-05", "official", spark.createDataFrame([(day(1),)], "date date")).first().reason == "store_current"
    with pytest.raises(ValueError):
        quality.rebuild_dimension(spark.createDataFrame([("000001",)], "code string"), 5)


def test_orders_and_weights(spark):
    orders = spark.createDataFrame([("buy", 100, 10.0, None, 1e9, None), ("buy", 150, 10.0, 1e6, 1e9, None), ("sell", 100, 10.0, None, None, 50), ("buy", 100, 10.0, 10.0, 100.0, None)], "side string, qty long, price double, cash double, equity double, sellable_qty long")
    assert [(r.status, r.violations) for r in B.screen_orders(orders).collect()] == [("skip", []), ("fail", ["lot"]), ("fail", ["sellable"]), ("fail", ["cash", "position"])]
    w = frame(B.rank_linear_weights(spark.createDataFrame([(1, f"{k:02d}", float(k)) for k in range(10)], "date int, symbol string, score double"), "score", "date"), "symbol")["weight"]
    assert w.sum() == pytest.approx(1) and w.is_monotonic_increasing and w.max() / w.min() < 2.1


def test_empty_panels(spark):
    empty = panel(spark).withColumn("amount", F.lit(1.0)).limit(0)
    for op in (windows.factor_scores, windows.factor_values, windows.kdj, windows.technical, windows.symbolic_state, R.market_breadth, R.adv_vol, windows.forward_returns):
        assert op(empty).count() == 0


def test_plans_push_filters_and_prune_columns(spark, sf_dir):
    x = panels.read(spark, sf_dir, "lineitem").where("l_quantity > 30").select("l_suppkey")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "l_comment" not in plan
    bars = panels.bars(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in bars and bars.count("Exchange hashpartitioning") <= 2
