"""Weights, portfolio returns, costs, performance and risk rules, for all days, curves and variants at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def normalize_weights(df: DataFrame, *keys: str, weight: str = "weight") -> DataFrame:
    """Weights by their sum; a group with a missing, non-positive or non-finite weight is an error, named in ``error``."""
    w = Window.partitionBy(*keys)
    x = S.finite(weight)
    bad = F.max(F.when(x.isNull() | (x <= 0), 1).otherwise(0)).over(w) == 1
    return df.withColumn("error", F.when(bad, F.lit("invalid_weight"))).withColumn("weight", F.when(F.col("error").isNull(), x / F.sum(x).over(w)))


def weights_from_targets(df: DataFrame, *keys: str, weight: str = "weight") -> DataFrame:
    """Target weights of each day; if any item of a day lacks one, the whole day is equal-weighted."""
    w = Window.partitionBy(*keys)
    lacking = F.max(F.when(F.col(weight).isNull() | (F.col(weight) <= 0), 1).otherwise(0)).over(w) == 1
    raw = F.when(lacking, 1.0).otherwise(F.col(weight))
    return df.withColumn("__raw", raw).withColumn("weight", F.col("__raw") / F.sum("__raw").over(w)).drop("__raw")


def rank_linear_weights(df: DataFrame, score: str, *keys: str, lo: float = 0.6, hi: float = 1.21, rounds: int = 6, tie: str = "symbol") -> DataFrame:
    """Weights linear in rank from ``hi`` to ``lo`` times 1/n, clipped and scaled to one again for a fixed number of rounds.

    Each round is a window pass over the cross-section: no call for each day, and no limit on its size."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(F.desc(score), tie)) - 1
    x = df.withColumn("__n", n).withColumn("weight", F.when(F.col("__n") > 1, hi - (hi - lo) * place / (F.col("__n") - 1)).otherwise(1.0) / F.col("__n"))
    for _ in range(rounds):
        x = x.withColumn("weight", F.col("weight") / F.sum("weight").over(w))
        x = x.withColumn("weight", F.least(F.greatest(F.col("weight"), lo / F.col("__n")), hi / F.col("__n")))
    return x.withColumn("weight", F.col("weight") / F.sum("weight").over(w)).drop("__n")


def combine_legs(legs: DataFrame) -> DataFrame:
    """(leg, leg_weight, date, symbol, weight) to one weight for each day and symbol: legs are normalised by day, then summed."""
    w = Window.partitionBy("leg", "date")
    x = legs.withColumn("__w", F.col("leg_weight") * F.col("weight") / F.sum("weight").over(w))
    return x.groupBy("date", "symbol").agg(F.sum("__w").alias("weight"), F.count(F.lit(1)).alias("legs"))


def portfolio_returns(weights: DataFrame, returns: DataFrame, cost_bps: float = 10.0, arm: str | None = None) -> DataFrame:
    """Daily return, turnover (half the change of weights), cost and net value of weights held over the next return.

    The weight of the session before comes from a session index and one full join, so that names that leave count too."""
    keys = [arm] if arm else []
    # a row for each session
    cal = weights.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("__i"))
    x = weights.join(F.broadcast(cal), "date").select(*keys, "symbol", "__i", "weight")
    before = x.select(*keys, "symbol", (F.col("__i") + 1).alias("__i"), F.col("weight").alias("__before"))
    change = x.join(before, [*keys, "symbol", "__i"], "full_outer").join(F.broadcast(cal), "__i")
    turn = change.groupBy(*keys, "date").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("__before", F.lit(0.0)))) / 2).alias("turnover"))
    gross = weights.join(returns, ["date", "symbol"]).groupBy(*keys, "date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    out = gross.join(turn, [*keys, "date"]).withColumn("cost", F.col("turnover") * cost_bps / 1e4).withColumn("net", F.col("gross") - F.col("cost"))
    own = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("equity", F.exp(F.sum(F.log(F.greatest(1 + F.col("net"), F.lit(1e-12)))).over(own)))


def curve_metrics(curve: DataFrame, year: int = 252) -> DataFrame:
    """CAGR, Sharpe, Sortino, largest drawdown, Calmar, recovery, half-split efficiency and steadiness of segments by curve."""
    own = Window.partitionBy("curve_id").orderBy("date")
    whole = Window.partitionBy("curve_id")
    x = curve.select("curve_id", "date", "equity", (F.col("equity") / F.lag("equity").over(own) - 1).alias("r"), (1 - F.col("equity") / F.max("equity").over(own.rowsBetween(Window.unboundedPreceding, 0))).alias("dd"), F.row_number().over(own).alias("k"), F.count(F.lit(1)).over(whole).alias("n"))
    half = F.floor(F.col("n") / 2)
    x = x.withColumn("seg", F.floor((F.col("k") - 1) * 4 / F.col("n")))
    agg = x.groupBy("curve_id").agg(
        F.count(F.lit(1)).alias("days"), F.min_by("equity", "k").alias("first"), F.max_by("equity", "k").alias("last"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"),
        F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least("r", F.lit(0.0)), F.lit(2))))).alias("down"), F.max("dd").alias("max_drawdown"), F.max_by("equity", F.when(F.col("k") <= half, F.col("k"))).alias("mid"),
    )
    segs = x.groupBy("curve_id", "seg").agg((F.max_by("equity", "k") / F.min_by("equity", "k") - 1).alias("g")).groupBy("curve_id").agg(F.avg("g").alias("gm"), F.stddev_samp("g").alias("gs"))
    total = F.col("last") / F.col("first") - 1
    out = agg.join(segs, "curve_id")
    return out.select(
        "curve_id", "days", total.alias("total"), (F.pow(F.col("last") / F.col("first"), year / (F.col("days") - 1)) - 1).alias("cagr"), S.safe_div(F.col("mean"), F.col("std"), eps=1e-12).alias("__s"), (S.safe_div(F.col("mean"), F.col("std"), eps=1e-12) * year**0.5).alias("sharpe"),
        (S.safe_div(F.col("mean"), F.col("down"), eps=1e-12) * year**0.5).alias("sortino"), "max_drawdown", S.safe_div(total, F.col("max_drawdown"), eps=1e-12).alias("recovery"),
        S.safe_div(F.col("last") / F.col("mid") - 1, F.col("mid") / F.col("first") - 1, eps=1e-12).alias("efficiency"), S.safe_div(F.col("gs"), F.abs("gm"), eps=1e-12).alias("segment_cv"),
    ).drop("__s")


def trade_metrics(trades: DataFrame, key: str, pnl: str = "pnl", cap: float = 999.0) -> DataFrame:
    p = F.col(pnl)
    win, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))
    return trades.groupBy(key).agg(F.count(F.lit(1)).alias("trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.when(loss > 0, F.least(win / F.greatest(loss, F.lit(1e-300)), F.lit(cap))).otherwise(F.when(win > 0, cap).otherwise(0.0)).alias("profit_factor"), F.avg(p).alias("expectancy"))


def verdict(metrics: DataFrame, key: str, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """PASS, FAIL or INSUFFICIENT_DATA of each metric against (operator, limit)."""
    x = metrics.unpivot([key], list(thresholds), "metric", "value")
    ok = F.lit(None).cast("boolean")
    for m, (op, t) in thresholds.items():
        ok = F.when(F.col("metric") == m, F.col("value") >= t if op == ">=" else F.col("value") <= t).otherwise(ok)
    return x.select(key, "metric", "value", F.when(ok.isNull(), F.lit("INSUFFICIENT_DATA")).when(ok, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"))


def turnover_definitions(targets: DataFrame) -> DataFrame:
    """Name turnover and half the sum of weight changes, with cash, between each day's weights and the day's before."""
    cal = targets.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("__i"))
    x = targets.join(F.broadcast(cal), "date").select("symbol", "__i", "weight")
    before = x.select("symbol", (F.col("__i") + 1).alias("__i"), F.col("weight").alias("__b"))
    j = x.join(before, ["symbol", "__i"], "full_outer").join(F.broadcast(cal), "__i")
    entered, left_ = F.count_if(F.col("__b").isNull()), F.count_if(F.col("weight").isNull())
    held, had = F.count("weight"), F.count("__b")
    cash = F.abs(F.sum(F.coalesce("weight", F.lit(0.0))) - F.sum(F.coalesce("__b", F.lit(0.0))))
    delta = F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))))
    out = j.groupBy("date").agg((F.greatest(entered, left_) / F.greatest(held, had)).alias("name_turnover"), ((delta + cash) / 2).alias("weight_turnover"), had.alias("before"))
    return out.select("date", F.when(F.col("before") > 0, F.col("name_turnover")).alias("name_turnover"), F.when(F.col("before") > 0, F.col("weight_turnover")).alias("weight_turnover"), F.when(F.col("before") > 0, F.lit("ok")).otherwise(F.lit("missing")).alias("status"))


def fill_costs(fills: DataFrame) -> DataFrame:
    """Errors of each fill and its cost: slippage that the fill price has in it isn't counted again with explicit fees."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    errors = F.filter(
        F.array(F.when(~(F.col("qty") > 0), F.lit("qty")), F.when(~(F.col("fill_price") > 0), F.lit("fill_price")), F.when(~F.col("side").isin("buy", "sell"), F.lit("side")), F.when(F.col("tax") > 0.07, F.lit("tax"))), lambda e: e.isNotNull()
    )
    amount = F.col("qty") * F.col("fill_price")
    x = fills.withColumn("errors", errors).withColumn("price_cost", sign * (F.col("fill_price") - F.col("decision_price")) * F.col("qty"))
    return x.withColumn("explicit_cost", S.fees(amount, F.col("side"))).withColumn("total_cost", F.when(F.size("errors") == 0, F.col("price_cost") + F.col("explicit_cost")))


def dividends(positions: DataFrame) -> DataFrame:
    """Bonus shares floor(q / 10 * ratio), cash by ten shares, and the tax by days held: 20 %, 10 % over 30 days, none over 365."""
    days = F.date_diff("ex_date", "buy_date")
    cash = F.col("qty") / 10 * F.col("cash_per10")
    rate = F.when(days > 365, 0.0).when(days > 30, 0.1).otherwise(0.2)
    return positions.select("symbol", "ex_date", F.floor(F.col("qty") / 10 * F.col("bonus_per10")).alias("bonus_shares"), cash.alias("cash"), (cash * rate).alias("tax"))


def screen_orders(orders: DataFrame, lot: int = 100, cash_floor: float = 0.0, position_limit: float = 0.3) -> DataFrame:
    """Violations of each order; a limit whose input is missing is skipped, not passed."""
    amount = F.col("qty") * F.col("price")
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    found = F.array(
        F.when(~F.col("side").isin("buy", "sell"), F.lit("side")), F.when(F.col("qty") <= 0, F.lit("qty")), F.when(buy & (F.col("qty") % lot != 0), F.lit("lot")), F.when(buy & F.col("cash").isNotNull() & (F.col("cash") - amount < cash_floor), F.lit("cash")),
        F.when(sell & F.col("sellable_qty").isNotNull() & (F.col("qty") > F.col("sellable_qty")), F.lit("sellable")), F.when(buy & F.col("equity").isNotNull() & (amount > position_limit * F.col("equity")), F.lit("position")),
    )
    skipped = F.array(F.when(buy & F.col("cash").isNull(), F.lit("cash")), F.when(sell & F.col("sellable_qty").isNull(), F.lit("sellable")), F.when(buy & F.col("equity").isNull(), F.lit("position")))
    keep = lambda a: F.filter(a, lambda v: v.isNotNull())
    return orders.withColumn("violations", keep(found)).withColumn("skipped", keep(skipped)).withColumn("status", F.when(F.size("violations") > 0, F.lit("fail")).when(F.size("skipped") > 0, F.lit("skip")).otherwise(F.lit("pass")))


def slice_twap(orders: DataFrame, slices: int = 4, lot: int = 100) -> DataFrame:
    """Whole lots over slices, the first ones larger; a remainder under a lot goes to the last."""
    lots = F.floor(F.col("qty") / lot)
    x = orders.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    base = F.floor(lots / slices) + (F.col("slice") < lots % slices).cast("long")
    return x.withColumn("slice_qty", base * lot + F.when(F.col("slice") == slices - 1, F.col("qty") - lots * lot).otherwise(0))


def slice_vwap(orders: DataFrame, profile: DataFrame, lot: int = 100) -> DataFrame:
    """Whole lots by a volume profile, by largest remainder (ties to the earlier slice)."""
    x = orders.crossJoin(F.broadcast(profile))  # a row for each slice of a day
    lots = F.floor(F.col("qty") / lot)
    whole = Window.partitionBy("order_id")
    share = F.col("volume") / F.sum("volume").over(whole)
    x = x.withColumn("__exact", lots * share).withColumn("__base", F.floor(F.col("__exact")))
    left = lots - F.sum("__base").over(whole)
    place = F.row_number().over(whole.orderBy(F.desc(F.round(F.col("__exact") - F.col("__base"), 9)), "slice"))
    return x.withColumn("slice_qty", ((F.col("__base") + (place <= left).cast("long")) * lot).cast("long")).drop("__exact", "__base")


def split_decision(orders: DataFrame, cap: float = 0.1, most: int = 20) -> DataFrame:
    """Participation, slices needed under the cap, whether it takes several days, and the notional that can be filled."""
    p = S.safe_div(F.col("notional"), F.col("adv"))
    return orders.withColumn("participation", p).withColumn("slices", F.least(F.greatest(F.ceil(p / cap), F.lit(1)), F.lit(most)).cast("int")).withColumn("multi_day", p > cap * most).withColumn("fillable", F.least(F.col("notional"), F.col("adv") * cap * most))


def shadow_arms(panel: DataFrame, arms: list[str], label: str, n: int = 20, control: str | None = None) -> DataFrame:
    """One row for each day and arm: overlap with the control's top n, mean label of the top n, excess over the cross-section."""
    control = control or arms[0]
    long = panel.unpivot(["date", "symbol", label], arms, "arm", "score").where("score is not null")
    w = Window.partitionBy("date", "arm")
    x = long.withColumn("__r", F.row_number().over(w.orderBy(F.desc("score"), "symbol"))).withColumn("__base", F.avg(label).over(w))
    top = x.where(F.col("__r") <= n)
    ctrl = top.where(F.col("arm") == control).select("date", "symbol", F.lit(1).alias("__c"))
    j = top.join(ctrl, ["date", "symbol"], "left")
    out = j.groupBy("date", "arm").agg(F.count(F.lit(1)).alias("n"), F.count("__c").alias("common"), F.avg(label).alias("top_return"), F.first("__base").alias("benchmark"))
    return out.select("date", "arm", "n", (F.col("common") / (2 * F.col("n") - F.col("common"))).alias("jaccard"), "top_return", (F.col("top_return") - F.col("benchmark")).alias("excess"))


def trim_sensitivity(panel: DataFrame, score: str, label: str, qs: list[float], n: int = 20) -> DataFrame:
    """Top-n mean label by day when the best q of the scores is left out, for each q."""
    spark = panel.sparkSession
    grid = spark.createDataFrame([(float(q),) for q in qs], "q double")
    w = Window.partitionBy("date", "q")
    x = panel.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select("date", "symbol", score, label).crossJoin(F.broadcast(grid))
    x = x.withColumn("__k", F.row_number().over(w.orderBy(F.desc(score), "symbol"))).withColumn("__n", F.count(F.lit(1)).over(w))
    cut = F.floor(F.col("__n") * F.col("q") + 1e-9)
    return x.where((F.col("__k") > cut) & (F.col("__k") <= cut + n)).groupBy("q", "date").agg(F.avg(label).alias("ret"))


def size_position(vol: Column, mu: Column, regime: Column, target: float = 0.15, kelly: float = 0.5) -> Column:
    """clip01(min(target / vol, kelly * mu / vol^2)) times the regime's multiplier (unknown: 0.75)."""
    mult = F.when(regime == "bull", 1.0).when(regime == "sideways", 0.8).when(regime == "bear", 0.5).when(regime == "high_vol", 0.4).otherwise(0.75)
    return S.clip(F.least(target / vol, kelly * mu / (vol * vol)), 0, 1) * mult


def breaker_level(drawdown: Column, vol: Column, cvar: Column, change: Column) -> Column:
    """Number of tripped thresholds, three at most."""
    tripped = (drawdown > 0.1).cast("int") + (vol > 0.3).cast("int") + (cvar > 0.05).cast("int") + (change > 0.03).cast("int")
    return F.least(tripped, F.lit(3))


def outlier_confidence(c: str = "value", n: int = 20) -> Column:
    """1 within 2.5 deviations of the last n values (today's too), else falling to 0.1; deviation 1 before n values."""
    w = S.by_symbol().rowsBetween(-(n - 1), 0)
    std = F.when(F.count(c).over(w) >= n, F.stddev_pop(c).over(w)).otherwise(1.0)
    dev = S.safe_div(F.abs(F.col(c) - F.avg(c).over(w)), std, 0.0, 1e-12)
    return F.when(dev <= 2.5, 1.0).otherwise(F.greatest(F.lit(0.1), F.exp(-(dev - 2.5) / 2)))
