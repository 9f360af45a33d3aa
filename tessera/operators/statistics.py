"""Statistics of strategies: overfitting, change points, control charts, gates; recursions by group in pandas only where needed."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def control_limits(series: DataFrame, n: int = 20, sigma: float = 3.0) -> DataFrame:
    """Rolling mean and limits by indicator."""
    w = Window.partitionBy("indicator").orderBy("date").rowsBetween(-(n - 1), 0)
    m, s = F.avg("value").over(w), F.stddev_samp("value").over(w)
    return series.withColumns({"mean": m, "ucl": m + sigma * s, "lcl": m - sigma * s})


def we_rules(series: DataFrame) -> DataFrame:
    """Runs: 9 on one side of the mean, 6 monotone, 4 of 5 beyond one deviation, 8 beyond one deviation."""
    own = Window.partitionBy("indicator").orderBy("date")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order of date, so that a value that equals the mean has the same sign in any run
    x = series.withColumns({"__m": F.avg("value").over(whole), "__s": F.stddev_samp("value").over(whole), "__p": F.lag("value").over(own)})
    side, step = F.signum(F.col("value") - F.col("__m")), F.signum(F.col("value") - F.col("__p"))
    out = (F.abs(F.col("value") - F.col("__m")) > F.col("__s")).cast("int")
    x = x.withColumns({"__side": side, "__step": step, "__out": out, "__hi": (F.col("value") > F.col("__m") + F.col("__s")).cast("int"), "__lo": (F.col("value") < F.col("__m") - F.col("__s")).cast("int")})
    r = lambda k: own.rowsBetween(-(k - 1), 0)
    return x.select(
        "indicator", "date", "value", (F.abs(F.sum("__side").over(r(9))) == 9).alias("same_side_9"), (F.abs(F.sum("__step").over(r(6))) == 6).alias("monotone_6"),
        ((F.sum("__hi").over(r(5)) >= 4) | (F.sum("__lo").over(r(5)) >= 4)).alias("beyond_4_of_5"), (F.sum("__out").over(r(8)) == 8).alias("beyond_8"),
    )


def cusum(series: DataFrame, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """Two-sided sums by their closed form: the cumulated deviations less their least value so far (and zero)."""
    by = Window.partitionBy("indicator").orderBy("date")
    whole, own = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, 0)
    x = series.withColumns({"__m": F.avg("value").over(whole), "__s": F.stddev_samp("value").over(whole)})
    up, down = F.col("value") - F.col("__m") - k * F.col("__s"), F.col("__m") - F.col("value") - k * F.col("__s")
    x = x.withColumns({"__u": F.sum(up).over(own), "__d": F.sum(down).over(own)})
    hi = F.col("__u") - F.least(F.lit(0.0), F.min("__u").over(own))
    lo = F.col("__d") - F.least(F.lit(0.0), F.min("__d").over(own))
    x = x.withColumns({"cusum_up": hi, "cusum_down": lo})
    return x.select("indicator", "date", "cusum_up", "cusum_down", (F.greatest("cusum_up", "cusum_down") > h * F.col("__s")).alias("alarm"))


def pinned(series: DataFrame, limit: float, n: int = 10, least: int = 6, tol: float = 0.01) -> DataFrame:
    """Whether at least so many of the last n values stay within ``tol`` of a limit."""
    w = Window.partitionBy("indicator").orderBy("date").rowsBetween(-(n - 1), 0)
    hits = F.sum((F.abs(F.col("value") - limit) <= tol).cast("int")).over(w)
    return series.select("indicator", "date", hits.alias("hits"), (hits >= least).alias("pinned"))


def spc_level(series: DataFrame, limit: float, n: int = 20) -> DataFrame:
    """P0 beyond the limits, P1 by the sums, P2 by the runs, P3 pinned, else OK, for many indicators at once."""
    keys = ["indicator", "date"]
    x = control_limits(series, n).join(we_rules(series).drop("value"), keys).join(cusum(series), keys).join(pinned(series, limit), keys)
    level = (
        F.when((F.col("value") > F.col("ucl")) | (F.col("value") < F.col("lcl")), F.lit("P0"))
        .when(F.col("alarm"), F.lit("P1"))
        .when(F.col("same_side_9") | F.col("monotone_6") | F.col("beyond_4_of_5") | F.col("beyond_8"), F.lit("P2"))
        .when(F.col("pinned"), F.lit("P3"))
        .otherwise(F.lit("OK"))
    )
    return x.select(*keys, level.alias("level"))


def market_regime(market: DataFrame, n: int = 20, bull: float = 0.05, bear: float = -0.05, high_vol: float = 0.3, year: int = 252) -> DataFrame:
    """high_vol, bull, bear, sideways or unknown from the last n returns of a market series (a row for each day)."""
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    x = market.select("date", F.count("ret").over(w).alias("n"), (F.exp(F.sum(F.log(1 + F.col("ret"))).over(w)) - 1).alias("trend"), (F.stddev_samp("ret").over(w) * year**0.5).alias("vol"))
    label = F.when(F.col("n") < n, F.lit("unknown")).when(F.col("vol") > high_vol, F.lit("high_vol")).when(F.col("trend") > bull, F.lit("bull")).when(F.col("trend") < bear, F.lit("bear")).otherwise(F.lit("sideways"))
    return x.select("date", "trend", "vol", label.alias("regime"))


def sharpe_change(curve: DataFrame, win: int = 20, swing: int = 10, threshold: float = 1.0, last: int = 5, year: int = 252) -> DataFrame:
    """Rolling Sharpe, its swing over ten days, and whether one of the last jumps exceeds max(threshold, mean + 2 deviations)."""
    own = Window.partitionBy("curve_id").orderBy("date")
    w = own.rowsBetween(-(win - 1), 0)
    x = curve.select("curve_id", "date", F.when((F.count("ret").over(w) >= win) & (F.stddev_samp("ret").over(w) > 1e-12), F.avg("ret").over(w) / F.stddev_samp("ret").over(w) * year**0.5).alias("sharpe"))
    x = x.where("sharpe is not null").withColumn("swing", F.abs(F.col("sharpe") - F.lag("sharpe", swing).over(own))).withColumn("__j", F.abs(F.col("sharpe") - F.lag("sharpe").over(own)))
    x = x.withColumn("__k", F.row_number().over(Window.partitionBy("curve_id").orderBy(F.desc("date"))))
    out = x.groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"), F.avg("__j").alias("mean"), F.stddev_samp("__j").alias("std"), F.max(F.when(F.col("__k") <= last, F.col("__j"))).alias("jump"), F.max("swing").alias("swing"))
    return out.select("curve_id", "n", "swing", "jump", (F.col("jump") > F.greatest(F.lit(threshold), F.col("mean") + 2 * F.col("std"))).alias("change_point"))


def regime_stats(ics: DataFrame, n: int = 20) -> DataFrame:
    """Mean, negative share and ratio of the last n ICs of a strategy."""
    w = Window.partitionBy("strategy_id").orderBy("date").rowsBetween(-(n - 1), 0)
    x = ics.select("strategy_id", "date", F.avg("ic").over(w).alias("m"), F.avg((F.col("ic") < 0).cast("double")).over(w).alias("neg"), F.stddev_samp("ic").over(w).alias("s"))
    return x.select("strategy_id", "date", "m", "neg", S.safe_div(F.col("m"), F.col("s"), eps=1e-12).alias("ir"))


def regime_of(risk_mean: Column | float = 0.0, risk_neg: Column | float = 0.55, risk_ir: Column | float = 0.0, normal_mean: Column | float = 0.02) -> Column:
    """normal, caution, risk or unknown by the thresholds, over the columns of ``regime_stats``."""
    risk = (F.col("m") < risk_mean) & (F.col("neg") > risk_neg) & F.coalesce(F.col("ir") < risk_ir, F.lit(True))
    return F.when(F.col("m").isNull(), F.lit("unknown")).when(risk, F.lit("risk")).when(F.col("m") >= normal_mean, F.lit("normal")).otherwise(F.lit("caution"))


def raw_regime(ics: DataFrame, n: int = 20, risk_mean: float = 0.0, risk_neg: float = 0.55, risk_ir: float = 0.0, normal_mean: float = 0.02) -> DataFrame:
    """normal, caution, risk or unknown from the mean, negative share and ratio of the last n ICs of a strategy."""
    return regime_stats(ics, n).select("strategy_id", "date", regime_of(risk_mean, risk_neg, risk_ir, normal_mean).alias("raw"))


#: State of a gate before its first day: whether the run of days at hand is of risk, its length, and whether risk is in force.
GATE_START = (None, 0, False)


def confirm(state: tuple, raw: str | None, enter: int, leave: int) -> tuple[tuple, str | None]:
    """One more day of a gate: its new state and regime, by the runs that ``confirmed`` counts.

    A run of risk days puts risk in force once it is ``enter`` long, one of other days ends it once it is ``leave`` long."""
    if raw not in ("normal", "caution", "risk"):
        return state, raw
    kind = raw == "risk"
    length = state[1] + 1 if state[0] == kind else 1
    in_force = kind if length >= (enter if kind else leave) else state[2]
    mild = "caution" if kind else raw
    return (kind, length, in_force), "risk" if in_force else mild


def regimes(raws, enter: int, leave: int) -> list[str | None]:
    """The regimes of one strategy's days in order."""
    out, state = [], GATE_START
    for raw in raws:
        state, regime = confirm(state, raw, enter, leave)
        out.append(regime)
    return out


def confirmed(raws: DataFrame, keys: list[str], enter: Column | int, leave: Column | int) -> DataFrame:
    """Adds ``regime``, the states that ``confirm`` gives day by day, without a recursion.

    Risk begins where a run of risk days is ``enter`` long and ends where a run of other days is ``leave`` long, so the state
    is that of the last such day; days of unknown state take no part."""
    own = Window.partitionBy(*keys).orderBy("date")
    past, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    risk = F.col("__risk")
    x = raws.withColumn("__risk", F.when(F.col("raw").isin("normal", "caution", "risk"), (F.col("raw") == "risk").cast("int")))
    x = x.withColumn("__before", F.last("__risk", ignorenulls=True).over(past))
    x = x.withColumn("__run", F.sum((risk.isNotNull() & ~risk.eqNullSafe(F.col("__before"))).cast("int")).over(upto))
    x = x.withColumn("__long", F.count("__risk").over(Window.partitionBy(*keys, "__run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__event", F.when((risk == 1) & (F.col("__long") >= enter), 1).when((risk == 0) & (F.col("__long") >= leave), 0))
    x = x.withColumn("__state", F.coalesce(F.last("__event", ignorenulls=True).over(upto), F.lit(0)))
    regime = F.when(risk.isNull(), F.col("raw")).when(F.col("__state") == 1, F.lit("risk")).when(risk == 1, F.lit("caution")).otherwise(F.col("raw"))
    return x.withColumn("regime", regime).drop("__risk", "__before", "__run", "__long", "__event", "__state")


def hysteresis(raws: DataFrame, enter: int = 3, leave: int = 3) -> DataFrame:
    """The confirmation of states over each strategy's history."""
    return confirmed(raws.select("strategy_id", "date", "raw"), ["strategy_id"], enter, leave)


def gated_curve(days: DataFrame, keys: list[str], lag: int = 1, cost_bps: float = 10.0) -> DataFrame:
    """Adds exposure, shift, net return, net value and its fall from the peak to days with regime, exposures and ``ret``."""
    own = Window.partitionBy(*keys).orderBy("date")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    want = F.when(F.col("regime") == "risk", F.col("risk_exposure")).when(F.col("regime") == "caution", F.col("caution_exposure")).otherwise(1.0)
    x = days.withColumn("held", F.coalesce(F.lag(want, lag).over(own), F.lit(1.0)))
    x = x.withColumn("shift", F.coalesce(F.abs(F.col("held") - F.lag("held").over(own)), F.lit(0.0)))
    x = x.withColumn("net", F.col("held") * F.coalesce("ret", F.lit(0.0)) - F.col("shift") * cost_bps / 1e4)
    x = x.withColumn("equity", F.exp(F.sum(F.log(1 + F.col("net"))).over(upto)))
    return x.withColumn("fall", 1 - F.col("equity") / F.max("equity").over(upto))


def gate_replay(returns: DataFrame, raws: DataFrame, grid: DataFrame, lag: int = 1, cost_bps: float = 10.0) -> DataFrame:
    """Net value of each strategy under each configuration (enter, leave, risk and caution exposure) of the gate, with costs of shifts.

    ``grid`` is a row for each configuration."""
    keys = ["strategy_id", "config_id"]
    days = returns.join(raws.select("strategy_id", "date", "raw"), "date").select("strategy_id", "date", "ret", "raw").crossJoin(F.broadcast(grid))
    x = gated_curve(confirmed(days, keys, F.col("enter"), F.col("leave")), keys, lag, cost_bps)
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), (F.max_by("equity", "date") - 1).alias("total"), F.max("fall").alias("max_drawdown"), F.avg("held").alias("mean_exposure"), F.count_if(F.col("shift") > 0).alias("shifts")
    )


#: The gate's parameters in force, and those that are tried.
GATE_CURRENT = {"risk_mean": -0.005, "risk_neg": 0.60, "risk_exposure": 0.90, "caution_exposure": 0.95, "hysteresis": 5}
GATE_TRIED = {
    "risk_mean": [-0.003, -0.006, -0.009, -0.012, -0.015],
    "risk_neg": [0.50, 0.55, 0.60, 0.65, 0.70],
    "risk_exposure": [0.70, 0.75, 0.80, 0.85, 0.90, 0.95],
    "caution_exposure": [0.80, 0.85, 0.90, 0.95, 1.00],
    "hysteresis": [2, 3, 4, 5],
}


def one_at_a_time() -> list[tuple]:
    """(config_id, param, value, then the five parameters): each value of each parameter with the others as they are."""
    rows = [(p, float(v), *(GATE_CURRENT | {p: v}).values()) for p, values in GATE_TRIED.items() for v in values]
    return [(i, *r) for i, r in enumerate(rows)]


def sampled(n: int = 200, seed: int = 42) -> list[tuple]:
    """As ``one_at_a_time``: ``n`` seeded draws of all parameters, each once, none with more exposure in risk than in caution."""
    import numpy as np

    rng, seen = np.random.default_rng(seed), []
    for _ in range(n):
        c = {p: float(rng.choice(values)) for p, values in GATE_TRIED.items()}
        if c not in seen and c["risk_exposure"] <= c["caution_exposure"]:
            seen.append(c)
    return [(i, "all", 0.0, *(GATE_CURRENT | c | {"hysteresis": int(c["hysteresis"])}).values()) for i, c in enumerate(seen)]


GATE_SCHEMA = "config_id int, param string, value double, risk_mean double, risk_neg double, risk_exposure double, caution_exposure double, hysteresis int"


def gate_sensitivity(returns: DataFrame, ics: DataFrame, grid: DataFrame, lag: int = 1, cost_bps: float = 10.0, year: int = 252) -> DataFrame:
    """What each configuration of the gate changes for each strategy: Sharpe ratio, growth and drawdown in percentage points,
    share of risk days and mean exposure."""
    keys = ["strategy_id", "config_id", "param", "value"]
    days = returns.join(regime_stats(ics), "date").crossJoin(F.broadcast(grid)).withColumn("raw", regime_of(F.col("risk_mean"), F.col("risk_neg")))
    x = gated_curve(confirmed(days, ["strategy_id", "config_id"], F.col("hysteresis"), F.col("hysteresis")), ["strategy_id", "config_id"], lag, cost_bps)
    own = Window.partitionBy("strategy_id", "config_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__r", F.coalesce("ret", F.lit(0.0))).withColumn("__e", F.exp(F.sum(F.log(1 + F.col("__r"))).over(own)))
    x = x.withColumn("__f", 1 - F.col("__e") / F.max("__e").over(own))
    sharpe = lambda c: F.when(F.stddev_samp(c) > 1e-12, F.avg(c) / F.stddev_samp(c) * year**0.5)
    growth = lambda c: F.pow(F.max_by(c, "date"), year / F.count(F.lit(1))) - 1
    return x.groupBy(*keys).agg(
        (sharpe("net") - sharpe("__r")).alias("sharpe_diff"), ((growth("equity") - growth("__e")) * 100).alias("growth_diff"), ((F.max("__f") - F.max("fall")) * 100).alias("drawdown_gain"),
        F.avg((F.col("regime") == "risk").cast("double")).alias("risk_share"), F.avg("held").alias("mean_exposure"),
    )


def gate_spread(rows: DataFrame) -> DataFrame:
    """Parameters of each strategy's gate ranked by how far the Sharpe ratio moves over the values tried."""
    x = rows.groupBy("strategy_id", "param").agg(F.count(F.lit(1)).alias("n"), (F.max("sharpe_diff") - F.min("sharpe_diff")).alias("sharpe_spread"), (F.max("growth_diff") - F.min("growth_diff")).alias("growth_spread"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("strategy_id").orderBy(F.round("sharpe_spread", 7).desc_nulls_last(), "param")))


def gate_passes(rows: DataFrame) -> DataFrame:
    """Whether a configuration costs little and helps enough; the bounds are fixed values."""
    ok = (F.col("sharpe_diff") > -0.05) & (F.col("drawdown_gain") >= 0.5) & F.col("risk_share").between(0.15, 0.25) & (F.col("growth_diff") > -2.0)
    return rows.withColumn("passes", F.coalesce(ok, F.lit(False)))


def normal_cdf(c: Column) -> Column:
    """Standard normal distribution by the series of erf's complement (error under 1.2e-7)."""
    z = F.abs(c) / 2**0.5
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(0.17087277)
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + a
    erfc = t * F.exp(-z * z + poly)
    return F.when(c >= 0, 1 - erfc / 2).otherwise(erfc / 2)


def sharpe_tests(curve: DataFrame, trials: int = 10, benchmark: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """Sharpe by observation, its probability over a benchmark, deflated for the number of trials, and the least track record."""
    x = curve.where("ret is not null").groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    x = x.withColumn("sharpe", S.safe_div(F.col("m"), F.col("s"), eps=1e-12))
    sr = F.col("sharpe")
    x = x.withColumn("__v", F.greatest(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr, F.lit(1e-12)))
    z = lambda b: (sr - b) * F.sqrt(F.col("n") - 1) / F.sqrt("__v")
    nd = NormalDist()
    gamma = 0.5772156649015329
    factor = (1 - gamma) * nd.inv_cdf(1 - 1 / trials) + gamma * nd.inv_cdf(1 - 1 / (trials * 2.718281828459045)) if trials > 1 else 0.0
    spread = F.stddev_samp("sharpe").over(Window.partitionBy())  # a row for each curve
    x = x.withColumn("__best", F.coalesce(spread, F.lit(0.0)) * factor)
    least = F.when(sr > benchmark, 1 + F.col("__v") * (nd.inv_cdf(confidence) / (sr - benchmark)) ** 2)
    return x.select("curve_id", "n", "sharpe", "skew", "kurt", normal_cdf(z(F.lit(benchmark))).alias("psr"), normal_cdf(z(F.col("__best"))).alias("dsr"), least.alias("min_track"))


def cscv_pbo(returns: DataFrame, blocks: int = 8, metric: Callable[[Column], Column] | None = None) -> DataFrame:
    """Probability of backtest overfitting by combinatorial symmetric cross-validation: one row.

    (block, config, ret) shrinks to moments; each half of the blocks is a row of a small table, and its Sharpe ratios come
    from summed moments, so the returns are read once whatever the number of combinations.  ``metric`` is another measure of
    a column of returns, any aggregate (a pandas one too); it sees all returns of each half, so they are repeated for each
    combination."""
    spark = returns.sparkSession
    halves = list(itertools.combinations(range(blocks), blocks // 2))
    combos = spark.createDataFrame([(i, b, b in half) for i, half in enumerate(halves) for b in range(blocks)], "combo int, block int, inside boolean")
    if metric:
        x = returns.join(F.broadcast(combos), "block").groupBy("combo", "config", "inside").agg(metric(F.col("ret")).cast("double").alias("sr"))
        return _pbo_of(x)
    m = returns.groupBy("block", "config").agg(F.count("ret").cast("double").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    x = m.join(F.broadcast(combos), "block").groupBy("combo", "config", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    return _pbo_of(x.select("combo", "config", "inside", F.when(var > 1e-18, mean / F.sqrt(var)).otherwise(0.0).alias("sr")))


def _pbo_of(x: DataFrame) -> DataFrame:
    y = x.groupBy("combo", "config").agg(F.max(F.when(F.col("inside"), F.col("sr"))).alias("is_sr"), F.max(F.when(~F.col("inside"), F.col("sr"))).alias("oos_sr"))
    w = Window.partitionBy("combo")
    y = y.withColumns({"__best": F.row_number().over(w.orderBy(F.desc("is_sr"), "config")), "__rank": F.rank().over(w.orderBy("oos_sr")) + (F.count(F.lit(1)).over(Window.partitionBy("combo", "oos_sr")) - 1) / 2, "__n": F.count(F.lit(1)).over(w)})
    best = y.where("__best = 1").withColumn("omega", F.col("__rank") / (F.col("__n") + 1)).withColumn("lam", F.log(F.col("omega") / (1 - F.col("omega"))))
    return best.agg(F.count(F.lit(1)).alias("combos"), F.avg((F.col("lam") < 0).cast("double")).alias("pbo"), F.avg("lam").alias("lambda_mean"), F.avg("omega").alias("omega_mean"), F.regr_slope("oos_sr", "is_sr").alias("slope"), F.avg((F.col("oos_sr") < 0).cast("double")).alias("loss_prob"))


def _in_blocks(intervals: DataFrame, k: int) -> DataFrame:
    """Samples with their number ``__n`` and their block ``own`` of k contiguous ones, of which the first n % k have one more."""
    n = intervals.agg(F.count(F.lit(1)).alias("__n"))  # one row, summed before it is broadcast
    x = intervals.crossJoin(F.broadcast(n))
    small, extra = F.floor(F.col("__n") / k), F.col("__n") % k
    head = extra * (small + 1)
    return x.withColumn("own", F.when(F.col("i") < head, F.floor(F.col("i") / (small + 1))).otherwise(extra + F.floor((F.col("i") - head) / small)).cast("int"))


def _roles(x: DataFrame, tests: DataFrame, fold: str, embargo: float) -> DataFrame:
    """Roles of samples in each fold; ``tests`` has the blocks of each fold's test set, ``(fold, block)``.

    A training row whose label overlaps a test block's span is purged, one just after the last test row embargoed."""
    spans = x.groupBy("own").agg(F.min("t0").alias("a"), F.max("t1").alias("b"), F.max("i").alias("last")).withColumnRenamed("own", "block")
    one = tests.join(spans, "block").groupBy(fold).agg(F.collect_list(F.struct("block", "a", "b")).alias("__spans"), F.max("last").alias("__last"))
    y = x.crossJoin(F.broadcast(one))  # a row for each fold
    test = F.exists("__spans", lambda s: s["block"] == F.col("own"))
    overlap = F.exists("__spans", lambda s: (F.col("t0") <= s["b"]) & (F.col("t1") >= s["a"]))
    late = (F.col("i") > F.col("__last")) & (F.col("i") <= F.col("__last") + F.floor(F.col("__n") * embargo))
    return y.select(fold, "i", F.when(test, F.lit("test")).when(overlap, F.lit("purged")).when(late, F.lit("embargo")).otherwise(F.lit("train")).alias("role"))


def purged_folds(intervals: DataFrame, k: int = 5, embargo: float = 0.01) -> DataFrame:
    """(fold, i, role) of each sample (i, t0, t1) and fold: contiguous test folds; training rows whose label overlaps the test
    span are purged, those just after it embargoed."""
    tests = intervals.sparkSession.createDataFrame([(f, f) for f in range(k)], "fold int, block int")
    return _roles(_in_blocks(intervals, k), tests, "fold", embargo)


def cpcv_paths(k: int, tests: int) -> int:
    """Whole paths that the combinations' test blocks make."""
    return math.comb(k, tests) * tests // k


def cpcv(intervals: DataFrame, k: int = 6, tests: int = 2, embargo: float = 0.01) -> DataFrame:
    """(combo, i, role, block) for each combination of ``tests`` out of k contiguous blocks, in the order of their numbers.

    The embargo follows the last test row only."""
    if not 1 <= tests < k:
        raise ValueError("there must be one test block at least and one training block at least")
    combos = [(c, b) for c, chosen in enumerate(itertools.combinations(range(k), tests)) for b in chosen]
    x = _in_blocks(intervals, k)
    roles = _roles(x, intervals.sparkSession.createDataFrame(combos, "combo int, block int"), "combo", embargo)
    return roles.join(x.select("i", F.col("own").alias("block")), "i")


def sign_flips(values, most: int = 16, draws: int = 200_000, seed: int = 42) -> tuple[int, float | None, float | None, float | None]:
    """Patterns, mean, one-sided and two-sided share of one group's values; draws are counted with the observed pattern added."""
    import numpy as np

    x = np.asarray(values, float)
    n = len(x)
    if not n:
        return 0, None, None, None
    observed, exact = float(x.mean()), n <= most
    total = 1 << n if exact else draws
    rng, greater, beyond = np.random.RandomState(seed), 0, 0
    step = max(1, 1_000_000 // n)  # blocks of rows go on with one stream of draws
    for k in range(0, total, step):
        m = min(step, total - k)
        if exact:
            signs = ((np.arange(k, k + m)[:, None] >> np.arange(n)) & 1) * 2.0 - 1.0
        else:
            signs = rng.choice(np.array([-1.0, 1.0]), size=(m, n))
        s = signs @ x / n
        greater += int((s >= observed - 1e-12).sum())
        beyond += int((np.abs(s) >= abs(observed) - 1e-12).sum())
    one = 0 if exact else 1
    return total, observed, (greater + one) / (total + one), (beyond + one) / (total + one)


def sign_flip(groups: DataFrame, most: int = 16, draws: int = 200_000, seed: int = 42) -> DataFrame:
    """Share of sign patterns whose mean is at least the observed one: all 2^n patterns up to ``most`` values, else seeded draws.

    Each group's values, in order of ``k``, become one row; its patterns are made and counted in blocks."""
    rows = groups.where("x is not null").groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("x"))

    def run(batches):
        for pdf in batches:
            out = [(g, *sign_flips(x, most, draws, seed)) for g, x in zip(pdf["group"], pdf["x"], strict=True)]
            yield pd.DataFrame(out, columns=["group", "patterns", "mean", "p_greater", "p_two_sided"])

    return rows.mapInPandas(run, f"group {dict(groups.dtypes)['group']}, patterns long, mean double, p_greater double, p_two_sided double")


def robust_max_z(groups: DataFrame) -> DataFrame:
    """(max - median) / (1.4826 MAD), by the quartile range where the MAD is zero."""
    med = F.median("x").over(Window.partitionBy("group"))
    x = groups.withColumn("__m", med).withColumn("__d", F.abs(F.col("x") - F.col("__m")))
    y = x.groupBy("group").agg(F.first("__m").alias("median"), F.median("__d").alias("mad"), F.max("x").alias("top"), (F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"))
    scale = F.when(F.col("mad") > 1e-12, F.col("mad") * 1.4826).when(F.col("iqr") > 1e-12, F.col("iqr") / 1.349)
    return y.select("group", "median", "mad", ((F.col("top") - F.col("median")) / scale).alias("max_z"))


def risk_explained(returns: DataFrame, y: str, xs: list[str], key: str) -> DataFrame:
    """R squared of a least-squares fit with intercept: sums of products by key, then one small solve for each key."""
    import numpy as np

    cols = [y, *xs]
    ok = F.greatest(*[F.col(c).isNull() for c in cols])
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]]
    sums = returns.where(~ok).groupBy(key).agg(*aggs)
    k = len(xs)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                n = r["n"]
                cov = np.array([[r[f"p_{cols[min(i, j)]}_{cols[max(i, j)]}"] - r[f"s_{cols[i]}"] * r[f"s_{cols[j]}"] / n for j in range(k + 1)] for i in range(k + 1)])
                beta = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
                out.append((r[key], int(n), float(beta @ cov[1:, 0] / cov[0, 0]) if cov[0, 0] > 1e-18 and n > k + 1 else None))
            yield pd.DataFrame(out, columns=[key, "n", "r2"])

    return sums.mapInPandas(solve, f"{key} {dict(returns.dtypes)[key]}, n long, r2 double")


def degradation(perf: DataFrame) -> DataFrame:
    """Consistency of recent against earlier returns, decay of activity, drift of skew, slope, and a weighted index 0 to 100.

    The weights and levels are fixed values."""
    w = Window.partitionBy("strategy_id")
    x = perf.withColumn("__i", F.row_number().over(w.orderBy("date")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    late = F.col("__i") * 2 >= F.col("__n")
    a, b = F.when(~late, F.col("ret")), F.when(late, F.col("ret"))
    y = x.groupBy("strategy_id").agg(F.avg(a).alias("m0"), F.avg(b).alias("m1"), F.stddev_samp("ret").alias("s"), F.sum(F.when(~late, F.col("trades"))).alias("t0"), F.sum(F.when(late, F.col("trades"))).alias("t1"), F.skewness(a).alias("k0"), F.skewness(b).alias("k1"), F.regr_slope("ret", "__i").alias("slope"))
    cons = S.clip(S.safe_div(F.col("m0") - F.col("m1"), F.col("s"), 0.0), 0, 1)
    act = S.clip(1 - S.safe_div(F.col("t1").cast("double"), F.col("t0").cast("double"), 1.0), 0, 1)
    skew = S.clip(F.abs(F.col("k1") - F.col("k0")) / 2, 0, 1)
    down = S.clip(S.safe_div(-F.col("slope") * 100, F.col("s"), 0.0), 0, 1)
    y = y.withColumn("index", 100 * (0.35 * cons + 0.2 * act + 0.2 * skew + 0.25 * down))
    return y.select("strategy_id", cons.alias("consistency"), act.alias("activity"), skew.alias("skew"), down.alias("decline"), "index", F.when(F.col("index") >= 60, F.lit("severe")).when(F.col("index") >= 30, F.lit("warning")).otherwise(F.lit("ok")).alias("level"))


def weight_drift(weights: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Largest change of each factor's weight from day to day and from its first, and its autocorrelation."""
    own = Window.partitionBy("factor").orderBy("date")
    x = weights.withColumns({"__p": F.lag("weight").over(own), "__f": F.first("weight").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    return x.groupBy("factor").agg(F.count(F.lit(1)).alias("days"), F.max(F.abs(F.col("weight") - F.col("__p"))).alias("day_over_day"), F.max(F.abs(F.col("weight") - F.col("__f"))).alias("from_first"), S.correlation("weight", "__p").alias("autocorr"), (F.max(F.abs(F.col("weight") - F.col("__p"))) > threshold).alias("drifted"))
