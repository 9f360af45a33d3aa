"""Time-series operators over (symbol, date): windows by symbol, all days at once; exponential means are scans over blocks of days."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import by_symbol, c_exp, c_log, clip, safe_div, ts

sym = by_symbol  # a window by symbol in the order of dates


def frame(n: int, end: int = 0) -> Window:
    """The n rows that end ``end`` rows from the current one."""
    return sym().rowsBetween(end - n + 1, end)


def factor_scores(bars: DataFrame, *also: str) -> DataFrame:
    """Six scores for every day: signal, trend, govern, liquidity, volatility, momentum reversal; ``also`` names columns to keep."""
    chg = F.col("change_pct")
    mom = F.avg(chg).over(frame(20))
    vol = F.when(mom.isNotNull(), F.sqrt(F.greatest(F.avg(chg * chg).over(frame(20)) - mom * mom, F.lit(0.0))))
    sma20, sma60 = F.avg("close").over(frame(20)), F.avg("close").over(frame(60))
    x = bars.withColumns({"mom20": mom, "vol20": vol, "sma20": sma20, "sma60": sma60})
    c = F.col("close")
    up = (c > F.col("sma20")).cast("int") + (F.col("sma20") > F.col("sma60")).cast("int")
    down = (c < F.col("sma20")).cast("int") + (F.col("sma20") < F.col("sma60")).cast("int")
    return x.select(
        "symbol",
        "date",
        "mom20",
        "vol20",
        ((up - down) * F.col("turnover")).alias("f_signal"),
        F.when(up == 2, 1.0).when(down == 2, -1.0).otherwise(0.0).alias("f_trend"),
        clip(1 - F.abs(chg) / 10, -1, 1).alias("f_govern"),
        F.col("turnover").alias("f_liquidity"),
        F.when(F.coalesce(F.col("vol20"), F.lit(0.0)) == 0, 0.0).otherwise(1 - F.least(F.lit(1.0), F.col("vol20") / 5)).alias("f_vol"),
        (-F.col("mom20") / 5).alias("f_mom_rev"),
        *also,
    )


def returns(n: int) -> Column:
    """Return over n rows; null unless the earlier close is positive."""
    before = F.lag("close", n).over(sym())
    return F.when(before > 0, F.col("close") / before - 1)


def rsi_mean(n: int = 14) -> Column:
    d = F.col("close") - F.lag("close").over(sym())
    up, down = F.avg(F.greatest(d, F.lit(0.0))).over(frame(n)), F.avg(F.greatest(-d, F.lit(0.0))).over(frame(n))
    out = F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))
    return F.when(F.row_number().over(sym()) > n, out)


def hist_vol(n: int, year: int = 242) -> Column:
    """Annualised deviation of the n returns before the current row."""
    r = F.col("close") / F.lag("close").over(sym()) - 1
    return F.when(F.row_number().over(sym()) > n + 1, F.stddev_samp(r).over(sym().rowsBetween(-n, -1)) * year**0.5)


def true_range() -> Column:
    prev = F.lag("close").over(sym())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr_mean(n: int = 14) -> Column:
    return F.when(F.row_number().over(sym()) > n, F.avg(true_range()).over(frame(n)))


def max_drawdown(n: int) -> Column:
    """Largest fall from a running peak, in percent, over n + 1 closes; folded inside each frame."""
    closes = F.collect_list("close").over(frame(n + 1))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(s: Column, x: Column) -> Column:
        peak = F.greatest(s["peak"], x)
        return F.struct(peak.alias("peak"), F.greatest(s["dd"], (peak - x) / peak).alias("dd"))

    return F.when(F.row_number().over(sym()) > n, F.aggregate(closes, start, step)["dd"] * 100)


def volume_change(n: int) -> Column:
    before = F.lag("volume", n).over(sym())
    return F.when(before > 0, F.col("volume") / before - 1)


def volume_ratio(n: int) -> Column:
    before = F.avg("volume").over(sym().rowsBetween(-n, -1))
    return F.when((F.row_number().over(sym()) > n) & (before > 0), F.col("volume") / before)


def kdj(bars: DataFrame, n: int = 9) -> DataFrame:
    """K, D and J: the recursion over the last n values has a closed form in their lags."""
    lo, hi = F.min("low").over(frame(n)), F.max("high").over(frame(n))
    x = bars.withColumn("__rsv", F.when(hi > lo, (F.col("close") - lo) / (hi - lo) * 100).otherwise(50.0))
    a = 2 / 3
    k, d = F.lit(a**n * 50), F.lit(a**n * 50 * (1 + n / 3))
    for j in range(n):
        r = F.lag("__rsv", j).over(sym())
        k, d = k + r * (a**j / 3), d + r * ((j + 1) * a**j / 9)
    full = F.row_number().over(sym()) >= 2 * n - 1
    return x.withColumns({"k": F.when(full, k), "d": F.when(full, d)}).withColumn("j", 3 * F.col("k") - 2 * F.col("d")).drop("__rsv")


def factor_values(bars: DataFrame) -> DataFrame:
    """The registry of factors, all in one pass over all days."""
    return bars.select(
        "symbol",
        "date",
        returns(1).alias("ret_1"),
        returns(5).alias("ret_5"),
        returns(20).alias("ret_20"),
        (returns(5) - returns(20)).alias("mom_diff"),
        rsi_mean(14).alias("rsi_14"),
        hist_vol(20).alias("vol_20"),
        atr_mean(14).alias("atr_14"),
        max_drawdown(20).alias("mdd_20"),
        volume_change(5).alias("vchg_5"),
        volume_ratio(5).alias("vratio_5"),
    )


def adjusted_close(bars: DataFrame) -> DataFrame:
    """Closes rebuilt backwards from the last one by the chain of changes; a missing change counts as none."""
    grow = F.greatest(1 + F.coalesce(F.col("change_pct"), F.lit(0.0)) / 100, F.lit(1e-12))
    logs = F.sum(F.log(grow)).over(sym().rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("symbol")
    x = bars.withColumn("__logs", logs)
    return x.withColumn("adj_close", F.max_by("close", "date").over(whole) * F.exp(F.col("__logs") - F.max_by("__logs", "date").over(whole))).drop("__logs")


#: Calendar days of a block; a symbol's rows are dealt out by (symbol, block), so a long history is many tasks' work.
BLOCK_DAYS = 128


def in_blocks(df: DataFrame, *last: str, key: str = "symbol", date: str = "date") -> DataFrame:
    """Adds ``__b``, the row's block, ``__pos``, its place in it, ``__t``, its place in all of the key's rows (both from 0), and
    ``__last_c``, the value of each column c of ``last`` in the row before.

    Rows are sorted by block; what a block takes over from those before it comes from a row for each block."""
    x = df.withColumn("__b", F.floor(F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date")) / BLOCK_DAYS))
    w = Window.partitionBy(key, "__b").orderBy(date)
    x = x.withColumns({"__pos": F.row_number().over(w) - 1} | {f"__last_{c}": F.lag(c).over(w) for c in last})
    blocks, by_key = x.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"), *[F.max_by(c, date).alias(f"__end_{c}") for c in last]), Window.partitionBy(key).orderBy("__b")
    before = F.coalesce(F.sum("__n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(key, "__b", before.alias("__before"), *[F.lag(f"__end_{c}").over(by_key).alias(f"__end_{c}") for c in last])
    x = x.join(blocks, [key, "__b"]).withColumns({"__t": F.col("__before") + F.col("__pos")} | {f"__last_{c}": F.when(F.col("__pos") == 0, F.col(f"__end_{c}")).otherwise(F.col(f"__last_{c}")) for c in last})
    return x.drop("__before", *[f"__end_{c}" for c in last])


def ewm(df: DataFrame, means: dict[str, tuple[Column, float, int]], key: str = "symbol", date: str = "date") -> DataFrame:
    """Adds exponentially weighted means to rows that ``in_blocks`` has placed: ``name: (value, alpha, place of the first row)``.

    The recursion y = (1 - alpha) y + alpha x is an affine map, and maps compose, so blocks are summed up each on its own, and the
    ends of blocks are composed to what each block carries into the next.  Ends further back than ``reach`` rows weigh
    less than a double's last digit of any mean, so a carry sums up a bounded number of blocks."""
    w = Window.partitionBy(key, "__b").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    power = lambda alpha, n: F.pow(F.lit(1 - alpha), n)
    local = {}
    for name, (value, alpha, first) in means.items():
        term = F.when(F.col("__t") == first, value).when(F.col("__t") > first, alpha * value)
        local[f"__l_{name}"] = power(alpha, F.col("__pos")) * F.sum(term / power(alpha, F.col("__pos"))).over(w)
    x = df.withColumns(local)
    ends = x.groupBy(key, "__b").agg(F.max("__t").alias("__end"), *[F.coalesce(F.max_by(c, date), F.lit(0.0)).alias(c) for c in local])
    reach = math.ceil(max(-45 / math.log1p(-alpha) for _, alpha, _ in means.values()))
    near = F.collect_list(F.struct("__end", *local)).over(Window.partitionBy(key).orderBy("__end").rangeBetween(-reach, 0))
    ends = ends.withColumn("__near", near)
    out, by_key = {}, Window.partitionBy(key).orderBy("__b")

    def weighed(name: str, alpha: float) -> Callable[[Column, Column], Column]:
        return lambda acc, e: acc + power(alpha, F.col("__end") - e["__end"]) * e[f"__l_{name}"]

    for name, (_, alpha, _) in means.items():
        sums = F.aggregate("__near", F.lit(0.0), weighed(name, alpha))
        out[name] = F.coalesce(F.lag(sums).over(by_key), F.lit(0.0)).alias(f"__c_{name}")
    x = x.join(ends.select(key, "__b", *out.values()), [key, "__b"])
    for name, (_, alpha, first) in means.items():
        x = x.withColumn(name, F.when(F.col("__t") >= first, F.col(f"__l_{name}") + power(alpha, F.col("__pos") + 1) * F.col(f"__c_{name}")))
    return x.drop(*local, *[f"__c_{name}" for name in means])


def technical(bars: DataFrame) -> DataFrame:
    """Exponentially weighted RSI, MACD and ATR, from each symbol's first row on."""
    cols = ["symbol", "date", "high", "low", "close"]
    c, h, lo, before = (F.col(k).cast("double") for k in ("close", "high", "low", "__last_close"))
    move = c - before
    tr = F.greatest(h - lo, F.abs(h - before), F.abs(lo - before))  # greatest passes over what is missing
    x = ewm(in_blocks(bars.select(*cols), "close"), {
        "__up": (F.greatest(move, F.lit(0.0)), 1 / 14, 1), "__down": (F.greatest(-move, F.lit(0.0)), 1 / 14, 1), "atr": (tr, 1 / 14, 0), "__fast": (c, 2 / 13, 0), "__slow": (c, 2 / 27, 0),
    })
    x = ewm(x.withColumn("dif", F.col("__fast") - F.col("__slow")), {"dea": (F.col("dif"), 0.2, 0)})
    rsi = F.when(F.col("__down") != 0, 100 - 100 / (1 + F.col("__up") / F.col("__down")))
    return x.select(*cols, rsi.alias("rsi"), "dif", "dea", (2 * (F.col("dif") - F.col("dea"))).alias("macd"), "atr")


def technical_signal(tech: DataFrame, smooth: int = 5) -> DataFrame:
    """Weighted RSI, MACD, trend and breakout parts, scaled down in volatile markets; mean of the last rows.

    The thresholds and weights are fixed values."""
    c, rsi = F.col("close"), F.col("rsi")
    s20, s60 = ts("mean", "close", 20, 20), ts("mean", "close", 60, 60)
    h20, l20 = ts("max", "high", 20, 20), ts("min", "low", 20, 20)
    x = tech.withColumns({"s20": s20, "s60": s60, "h20": h20, "l20": l20})
    rsi_part = F.when(rsi > 70, -0.5).when(rsi < 30, 0.5).otherwise((rsi - 50) / 20)
    macd_part = F.when((F.col("macd") > 0) & (F.col("dif") > F.col("dea")), 0.3).when((F.col("macd") < 0) & (F.col("dif") < F.col("dea")), -0.3).otherwise(0.0)
    trend_part = F.when((c > F.col("s20")) & (F.col("s20") > F.col("s60")), 0.3).when((c < F.col("s20")) & (F.col("s20") < F.col("s60")), -0.3).otherwise(0.0)
    break_part = F.when(c > F.col("h20") * 0.98, 0.2).when(c < F.col("l20") * 1.02, -0.2).otherwise(0.0)
    scale = F.when(F.col("atr") > 0, F.least(F.lit(1.0), 0.02 / F.col("atr"))).otherwise(1.0)
    x = x.withColumn("raw_signal", (0.3 * rsi_part + 0.25 * macd_part + 0.25 * trend_part + 0.2 * break_part) * scale)
    return x.select("symbol", "date", "rsi", "macd", "atr", "raw_signal", F.avg("raw_signal").over(frame(smooth)).alias("signal"))


def trend_score(bars: DataFrame) -> DataFrame:
    """Score of the alignment of 20, 60 and 120-row means, zero before 120 rows."""
    m = {n: F.avg("close").over(frame(n)) for n in (20, 60, 120)}
    x = bars.withColumns({"__n": F.row_number().over(sym())} | {f"__m{n}": c for n, c in m.items()})
    c, a, b, d = F.col("close"), F.col("__m20"), F.col("__m60"), F.col("__m120")
    score = F.when(F.col("__n") < 120, 0.0).when((c > a) & (a > b) & (b > d), 1.0).when((c > a) & (a > b), 0.5).when(c > a, 0.3).when((c < a) & (a < b) & (b < d), -0.8).when((c < a) & (a < b), -0.4).otherwise(0.0)
    return x.select("symbol", "date", score.alias("trend_score"))


def symbolic_state(bars: DataFrame) -> DataFrame:
    """Alignment of means, place in the Bollinger band and range, breakout, volume-price state, percentile of ATR."""
    n = F.row_number().over(sym())
    x = bars.withColumns({"__n": n, "__tr": true_range()} | {f"__m{k}": F.when(n >= k, F.avg("close").over(frame(k))) for k in (5, 20, 60, 120)})
    x = x.withColumns(
        {
            "__sd": F.when(n >= 20, F.stddev_samp("close").over(frame(20))),
            "__h": F.max("high").over(frame(20)),
            "__l": F.min("low").over(frame(20)),
            "__c5": F.lag("close", 4).over(sym()),
            "__v20": F.avg("volume").over(frame(20)),
            "__atr": F.avg("__tr").over(frame(14)),
        }
    )
    c, m5, m20, m60, m120 = (F.col(k) for k in ("close", "__m5", "__m20", "__m60", "__m120"))
    align = (
        F.when(m120.isNull(), F.lit("unknown"))
        .when((c > m5) & (m5 > m20) & (m20 > m60) & (m60 > m120), F.lit("bullish_full"))
        .when((c > m20) & (m20 > m60) & (m60 > m120), F.lit("bullish_3"))
        .when((c > m20) & (m20 > m60), F.lit("bullish_2"))
        .when((c < m5) & (m5 < m20) & (m20 < m60) & (m60 < m120), F.lit("bearish_full"))
        .when((c < m20) & (m20 < m60) & (m60 < m120), F.lit("bearish_3"))
        .when((c < m20) & (m20 < m60), F.lit("bearish_2"))
        .otherwise(F.lit("ranging"))
    )
    bb = F.when(F.col("__sd") > 0, clip((c - (m20 - 2 * F.col("__sd"))) / (4 * F.col("__sd")), 0, 1)).otherwise(0.5)
    rng = F.when(F.col("__h") > F.col("__l"), clip((c - F.col("__l")) / (F.col("__h") - F.col("__l")), 0, 1)).otherwise(0.5)
    breakout = F.when(c >= F.col("__h") * 0.995, F.lit("resistance_break")).when(c <= F.col("__l") * 1.005, F.lit("support_break")).otherwise(F.lit("inside_range"))
    pc = F.when(F.col("__c5") > 0, c / F.col("__c5") - 1).otherwise(0.0)
    vc = safe_div(F.col("volume"), F.col("__v20"), 1.0)
    vp = (
        F.when(F.col("__n") < 20, F.lit("unknown"))
        .when((pc > 0.02) & (vc > 1.3), F.lit("vol_breakout_bull"))
        .when((pc > 0.02) & (vc < 0.8), F.lit("vol_divergence_bear"))
        .when((pc < -0.02) & (vc > 1.3), F.lit("vol_breakout_bear"))
        .when((pc < -0.02) & (vc < 0.8), F.lit("shrink_consolidate"))
        .otherwise(F.lit("vol_normal"))
    )
    x = x.withColumns({"alignment": align, "bb_position": bb, "range_position": rng, "breakout": breakout, "volume_price": vp})
    less = F.size(F.filter(F.collect_list("__atr").over(frame(60)), lambda a: a < F.col("__atr")))
    return x.select("symbol", "date", "alignment", "bb_position", "range_position", "breakout", "volume_price", F.when(F.col("__n") >= 60, less / 60.0).otherwise(0.5).alias("atr_percentile"))


#: Fixed scores of the states.
#: Scores of the states.
ALIGN_SCORE = {"bullish_full": 1.0, "bullish_3": 0.7, "bullish_2": 0.4, "bearish_full": -1.0, "bearish_3": -0.7, "bearish_2": -0.4}
VOLUME_SCORE = {"vol_breakout_bull": 0.6, "vol_divergence_bear": -0.3, "vol_breakout_bear": -0.6, "shrink_consolidate": 0.1}


def market_state(states: DataFrame) -> DataFrame:
    """Averages of the symbolic states over all symbols of a day, with a composite (of fixed weights) and its confidence."""
    def score(c: str, table: dict) -> Column:
        out = F.lit(0.0)
        for k, v in table.items():
            out = F.when(F.col(c) == k, v).otherwise(out)
        return out

    out = states.groupBy("date").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.avg(score("alignment", ALIGN_SCORE)).alias("trend"),
        F.avg(score("volume_price", VOLUME_SCORE)).alias("volume"),
        F.avg("bb_position").alias("bb_position"),
        F.avg(F.when(F.col("breakout") == "resistance_break", 1.0).when(F.col("breakout") == "support_break", -1.0).otherwise(0.0)).alias("breakout"),
    )
    out = out.withColumn("composite", 0.5 * F.col("trend") + 0.25 * F.col("volume") + 0.25 * F.col("breakout"))
    return out.withColumn("confidence", clip(F.abs("composite") * 2, 0, 1))


def cross_trend(bars: DataFrame, threshold: float = 0.02, pairs: tuple = ((5, 20), (10, 30), (20, 60))) -> DataFrame:
    """Trend label from pairs of means, with the place between support and resistance and a warning when means stick."""
    n = F.row_number().over(sym())
    ks = sorted({k for p in pairs for k in p})
    x = bars.withColumns({"__n": n} | {f"__m{k}": F.avg("close").over(frame(k)) for k in ks})
    x = x.withColumns({"__h": F.max("high").over(frame(20)), "__l": F.min("low").over(frame(20)), "__v": F.avg("volume").over(frame(20))})
    diffs = [(F.col(f"__m{a}") - F.col(f"__m{b}")) / F.col(f"__m{b}") for a, b in pairs]
    score = sum(diffs[1:], diffs[0]) / len(pairs)
    bull = sum(((d > threshold).cast("int") for d in diffs), F.lit(0)) / len(pairs)
    bear = sum(((d < -threshold).cast("int") for d in diffs), F.lit(0)) / len(pairs)
    place = F.when(F.col("__h") > F.col("__l"), clip((F.col("close") - F.col("__l")) / (F.col("__h") - F.col("__l")), 0, 1)).otherwise(clip(F.col("close") - F.col("__l"), 0, 1))
    x = x.withColumns({"score": score, "bull_ratio": bull, "bear_ratio": bear, "sr_position": place, "volume_ratio": safe_div(F.col("volume"), F.col("__v"), 1.0)})
    stuck = (F.abs(F.col("__m5") - F.col("__m20")) < threshold / 2) & (F.abs(F.col("__m20") - F.col("__m60")) < threshold / 2)
    label = F.when(stuck, F.lit("REVERSION_WARNING")).when((F.col("score") > threshold) & (F.col("sr_position") > 0.3), F.lit("UPTREND")).when((F.col("score") < -threshold) & (F.col("sr_position") < 0.7), F.lit("DOWNTREND")).otherwise(F.lit("OSCILLATE"))
    ready = F.col("__n") >= 60
    return x.select("symbol", "date", F.when(ready, label).otherwise(F.lit("OSCILLATE")).alias("state"), *[F.when(ready, F.col(c)).alias(c) for c in ("score", "bull_ratio", "bear_ratio", "sr_position", "volume_ratio")])


def with_forward(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), chg: str = "change_pct") -> DataFrame:
    """Adds the compounded change of the next h rows of the symbol; null where they aren't all there."""
    grow = F.greatest(1 + F.coalesce(F.col(chg), F.lit(0.0)) / 100, F.lit(1e-12))
    x = bars.withColumn("__logs", F.sum(F.log(grow)).over(sym().rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumns({f"fwd_{h}": F.exp(F.lead("__logs", h).over(sym()) - F.col("__logs")) - 1 for h in horizons}).drop("__logs")


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), chg: str = "change_pct") -> DataFrame:
    """Compounded change of the next h rows of the symbol; null where they aren't all there."""
    return with_forward(bars, horizons, chg).select("symbol", "date", *[f"fwd_{h}" for h in horizons])


def exact_labels(bars: DataFrame, calendar: DataFrame, horizons: tuple[int, ...] = (1, 3), source_max: Column | None = None) -> DataFrame:
    """Labels that need the next h calendar sessions exactly: the reason says why a label is missing.

    One window over session indices gives counts and products; no join from days to days. Logarithms are the C library's and are
    summed from the latest session back, so that labels half way between two rounded ones fall on the side of the SQL's."""
    ok = F.col("change_pct") > -100
    x = bars.withColumn("__log", c_log(F.when(ok, 1 + F.col("change_pct") / 100))).join(F.broadcast(calendar.select("date", "idx")), "date")
    # the calendar has one row for each session; its last index is a scalar
    x = x.crossJoin(F.broadcast(calendar.agg(F.max("idx").alias("__last")))) if source_max is None else x.withColumn("__last", source_max)
    w = Window.partitionBy("symbol").orderBy(F.desc("idx"))
    labels = []
    for h in horizons:
        r = w.rangeBetween(-h, -1)
        present, valid = F.count(F.lit(1)).over(r), F.count(F.when(ok, 1)).over(r)
        reason = F.when(F.col("idx") + h > F.col("__last"), F.lit("not_mature")).when(present < h, F.lit("missing_future_bar")).when(valid < h, F.lit("invalid_change_pct"))
        labels.append(F.struct(F.lit(h).alias("horizon"), F.sum("__log").over(r).alias("sum"), reason.alias("reason")))
    x = x.select("symbol", "date", F.array(*labels).alias("__labels")).select("symbol", "date", F.inline("__labels"))
    value = c_exp(F.when(F.col("reason").isNull(), F.col("sum"))) - 1
    return x.select("symbol", "date", "horizon", value.alias("forward_return"), F.col("reason").isNull().alias("valid"), "reason")


def open_entry_labels(bars: DataFrame, horizon: int = 3) -> DataFrame:
    """Bought at the open of the day: close by open of that row times the changes of the next horizon - 1 rows."""
    first = F.when(F.col("open") > 0, F.col("close") / F.col("open"))
    rest = F.exp(F.sum(F.log(1 + F.col("change_pct") / 100)).over(sym().rowsBetween(1, horizon - 1)))
    n = F.count(F.lit(1)).over(sym().rowsBetween(1, horizon - 1))
    return bars.select("symbol", "date", F.when(n == horizon - 1, first * rest - 1).alias("label"))


def rolling_features(panel: DataFrame, cols: list[str], windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Mean, deviation and rank of each column over each window, with w // 2 + 1 values at least."""
    return panel.select("symbol", "date", *[ts(fn, c, w).alias(f"{c}_{fn}_{w}") for c in cols for w in windows for fn in ("mean", "std", "rank")])


def risk_factors(returns_: DataFrame, n: int = 20, alpha: float = 0.05) -> DataFrame:
    """Deviation, mean of the worst part, drawdown of the compounded value and downside deviation over n rows."""
    r = F.col("ret")
    vals = F.sort_array(F.collect_list(r).over(frame(n)))
    x = returns_.withColumns({"__v": vals, "__n": F.count(r).over(frame(n)), "__seq": F.collect_list(r).over(frame(n)), "std": F.stddev_samp(r).over(frame(n))})
    k = F.greatest(F.ceil(F.col("__n") * alpha), F.lit(1)).cast("int")
    worst = F.slice("__v", 1, k)
    cvar = F.aggregate(worst, F.lit(0.0), lambda a, b: a + b) / k
    one = F.struct(F.lit(1.0).alias("nav"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(s: Column, v: Column) -> Column:
        nav = s["nav"] * (1 + v)
        peak = F.greatest(s["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"), F.greatest(s["dd"], 1 - nav / peak).alias("dd"))

    dd = F.aggregate("__seq", one, step)["dd"]
    down = F.sqrt(F.aggregate("__seq", F.lit(0.0), lambda a, b: a + F.when(b < 0, b * b).otherwise(0.0)) / F.col("__n"))
    ok = F.col("__n") >= 3
    return x.select("symbol", "date", F.when(ok, F.col("std")).alias("std"), F.when(ok, cvar).alias("cvar"), F.when(ok, dd).alias("drawdown"), F.when(ok, down).alias("downside"))


def expanding_zscore(panel: DataFrame, c: str, warmup: int = 10, limit: float = 5.0) -> DataFrame:
    w = sym().rowsBetween(Window.unboundedPreceding, 0)
    std = F.stddev_samp(c).over(w)
    z = F.when(std > 1e-12, clip((F.col(c) - F.avg(c).over(w)) / std, -limit, limit)).otherwise(0.0)
    return panel.select("symbol", "date", F.when(F.count(c).over(w) >= warmup, z).otherwise(0.0).alias("z"))


def haar_features(bars: DataFrame, window: int = 60, levels: int = 3) -> DataFrame:
    """Multi-scale features of the trailing rows by repeated halving: means of pairs go on to the next level, half differences
    are its details.

    ``trend_val`` and ``vol_val`` are the last places of the smooth part and of the finest details when their coefficients
    are spread evenly over the window (zero where none falls there), the ratios are their shares of the energy, whose
    logarithm is the last column.  Rows before a full window have zeros; a symbol with fewer rows has one row of features, its
    last, over them all."""
    own = Window.partitionBy("symbol")
    n, total = F.row_number().over(sym()), F.count(F.lit(1)).over(own)
    at = lambda a, i: F.element_at(a, i.cast("int"))
    pairs = lambda a: F.sequence(F.lit(1), F.floor(F.size(a) / 2).cast("int"))
    halved = lambda a, sign: F.when(F.size(a) >= 2, F.transform(pairs(a), lambda i: (at(a, 2 * i - 1) + sign * at(a, 2 * i)) / 2))
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)

    def last_place(a: Column) -> Column:
        step = F.floor(F.size("__x") / F.size(a))
        k = (F.size("__x") - 1) / step
        return F.when((k == F.floor(k)) & (k < F.size(a)), at(a, F.floor(k) + 1)).otherwise(0.0)

    full = (n >= window) | ((total < window) & (n == total) & (total >= 2))
    x = bars.select("symbol", "date", F.when(full, F.collect_list("close").over(frame(window))).alias("__x"))
    x = x.withColumn("__d", halved(F.col("__x"), -1)).withColumn("__a", F.col("__x"))
    for _ in range(levels):
        x = x.withColumn("__a", F.coalesce(halved(F.col("__a"), 1), F.col("__a")))
    energy = squares(F.col("__x")) + 1e-10
    out = {"trend_val": last_place(F.col("__a")), "vol_val": last_place(F.col("__d")), "trend_ratio": squares(F.col("__a")) / energy, "vol_ratio": squares(F.col("__d")) / energy, "energy_log": F.log1p(energy)}
    return x.select("symbol", "date", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in out.items()])


def fill_change(bars: DataFrame) -> DataFrame:
    """Missing changes from the previous close, rounded to four places."""
    prev = F.lag("close").over(sym())
    return bars.withColumn("change_pct", F.coalesce("change_pct", F.when((prev > 0) & (F.col("close") > 0), F.round((F.col("close") - prev) / prev * 100, 4))))


def trailing_stop(positions: DataFrame, stop_loss: float = 0.08, giveback: float = 0.1, hard_floor: float | None = None) -> DataFrame:
    """Stop line of each position day, the larger of the entry's and the peak's, and the first breach.

    ``positions`` has symbol, date, entry and price; a hard floor deepens the entry's tolerance."""
    w = sym().rowsBetween(Window.unboundedPreceding, 0)
    base = F.col("entry") * (1 - stop_loss)
    if hard_floor is not None:
        base = F.least(base, F.col("entry") * (1 - hard_floor))
    x = positions.withColumn("line", F.greatest(base, F.max("price").over(w) * (1 - giveback)))
    x = x.withColumn("breach", F.col("price") <= F.col("line"))
    first = F.min(F.when(F.col("breach"), F.col("date"))).over(Window.partitionBy("symbol"))
    return x.withColumn("first_breach", first)
