"""Queries over the time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import windows as W
from tessera.plans.registry import query
from tessera.sources import panels as P

O = "over (partition by symbol order by date"  # noqa: E741


def sql_frame(n: int, end: int = 0) -> str:
    a, b = n - 1 - end, -end
    return f"{O} rows between {a} preceding and {'current row' if not b else f'{b} preceding'})"


@query(
    "w01_factor_scores",
    "symbol date:d mom20:6 vol20:4 f_signal:6 f_trend f_govern:6 f_liquidity:6 f_vol:4 f_mom_rev:6",
    "bars",
    f"""x as (select *, avg(change_pct) {sql_frame(20)} as mom20, avg(change_pct * change_pct) {sql_frame(20)} as sq, avg(close) {sql_frame(20)} as sma20, avg(close) {sql_frame(60)} as sma60 from bars),
y as (select *, case when mom20 is not null then sqrt(greatest(sq - mom20 * mom20, 0)) end as vol20, cast(close > sma20 as int) + cast(sma20 > sma60 as int) as up, cast(close < sma20 as int) + cast(sma20 < sma60 as int) as dn from x)""",
    """select symbol, date, mom20, vol20, (up - dn) * turnover as f_signal, case when up = 2 then 1.0e0 when dn = 2 then -1.0e0 else 0.0e0 end as f_trend,
    case when change_pct is not null then least(greatest(1 - abs(change_pct) / 10, -1), 1) end as f_govern, turnover as f_liquidity,
    case when coalesce(vol20, 0) = 0 then 0 else 1 - least(1, vol20 / 5) end as f_vol, -mom20 / 5 as f_mom_rev from y""",
)
def _(spark, d):
    return W.factor_scores(P.bars(spark, d))


@query(
    "w09_factor_values",
    "symbol date:d ret_1:6 ret_5:6 ret_20:6 mom_diff:6 rsi_14:5 vol_20:5 atr_14:3 mdd_20:5 vchg_5:6 vratio_5:6",
    "bars",
    f"""x as (select *, row_number() {O}) as n, lag(close) {O}) as p1, lag(close, 5) {O}) as p5, lag(close, 20) {O}) as p20, lag(volume, 5) {O}) as v5,
    avg(volume) {sql_frame(5, -1)} as va, list(close) {sql_frame(21)} as cl from bars),
y as (select *, close / p1 - 1 as r, greatest(close - p1, 0) as u, greatest(p1 - close, 0) as dn, case when p1 is null then high - low else greatest(high - low, abs(high - p1), abs(low - p1)) end as tr from x),
z as (select *, avg(case when p1 is not null then u end) {sql_frame(14)} as au, avg(case when p1 is not null then dn end) {sql_frame(14)} as ad, stddev_samp(r) {sql_frame(20, -1)} as sd, avg(tr) {sql_frame(14)} as atr from y)""",
    """select symbol, date, case when p1 > 0 then close / p1 - 1 end as ret_1, case when p5 > 0 then close / p5 - 1 end as ret_5, case when p20 > 0 then close / p20 - 1 end as ret_20,
    (close / p5 - 1) - (close / p20 - 1) as mom_diff, case when n > 14 then case when au = 0 and ad = 0 then 50 when ad = 0 then 100 else 100 - 100 / (1 + au / ad) end end as rsi_14,
    case when n > 21 then sd * sqrt(242) end as vol_20, case when n > 14 then atr end as atr_14,
    case when n > 20 then 100 * list_max(list_transform(range(1, len(cl) + 1), lambda i: 1 - cl[i] / list_max(cl[1:i]))) end as mdd_20,
    case when v5 > 0 then volume / v5 - 1 end as vchg_5, case when n > 5 and va > 0 then volume / va end as vratio_5 from z""",
)
def _(spark, d):
    return W.factor_values(P.bars(spark, d))


@query(
    "w04_kdj",
    "symbol date:d k:5 d:5 j:4",
    "bars",
    f"""x as (select *, min(low) {sql_frame(9)} as lo, max(high) {sql_frame(9)} as hi, row_number() {O}) as n from bars),
y as (select *, case when hi > lo then (close - lo) / (hi - lo) * 100 else 50 end as rsv from x),
z as (select *, list(rsv) {sql_frame(9)} as l from y),
kk as (select *, list_reduce(list_prepend(50.0e0, l), lambda a, b: a * 2 / 3 + b / 3) as k,
    list_transform(range(1, 10), lambda i: list_reduce(list_prepend(50.0e0, l[1:i]), lambda a, b: a * 2 / 3 + b / 3)) as ks from z)""",
    """select symbol, date, case when n >= 17 then k end as k, case when n >= 17 then dd end as d, case when n >= 17 then 3 * k - 2 * dd end as j
    from (select *, list_reduce(list_prepend(50.0e0, ks), lambda a, b: a * 2 / 3 + b / 3) as dd from kk)""",
)
def _(spark, d):
    return W.kdj(P.bars(spark, d))


@query(
    "w10_adjusted_close",
    "symbol date:d log_adj:6",
    "bars",
    f"""x as (select *, product(greatest(1 + coalesce(change_pct, 0) / 100, 1e-12)) {O} rows unbounded preceding) as p from bars)""",
    "select symbol, date, ln(last(close) over w * p / last(p) over w) as log_adj from x window w as (partition by symbol order by date rows between unbounded preceding and unbounded following)",
)
def _(spark, d):
    return W.adjusted_close(P.bars(spark, d)).withColumn("log_adj", F.log("adj_close"))


def ewm_sql(values: str, alpha: str) -> str:
    """The exponentially weighted mean of a list, from its first value on."""
    return f"case when len({values}) > 0 then list_reduce({values}, lambda s, v: s * (1 - {alpha}) + v * {alpha}) end"


UPTO = "over (partition by symbol order by date rows unbounded preceding)"
TECHNICAL = f"""t0 as (select *, lag(close) {O}) as pc from bars),
t1 as (select *, close - pc as df, case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from t0),
t2 as (select *, list(close) {UPTO} as lc, list(greatest(df, 0)) filter (df is not null) {UPTO} as lu, list(greatest(-df, 0)) filter (df is not null) {UPTO} as ld, list(tr) {UPTO} as lt from t1),
t3 as (select *, {ewm_sql('lu', '(1 / 14.0e0)')} as up, {ewm_sql('ld', '(1 / 14.0e0)')} as dn, {ewm_sql('lt', '(1 / 14.0e0)')} as atr, {ewm_sql('lc', '(2 / 13.0e0)')} - {ewm_sql('lc', '(2 / 27.0e0)')} as dif from t2),
t4 as (select *, list(dif) {UPTO} as lf from t3),
te as (select symbol, date, high, low, close, case when dn != 0 then 100 - 100 / (1 + up / dn) end as rsi, dif, {ewm_sql('lf', '0.2e0')} as dea, atr from t4)"""


@query("w12_technical_ewm", "symbol date:d rsi:6 dif:6 dea:6 macd:6 atr:6", "bars", TECHNICAL, "select *, 2 * (dif - dea) as macd from te")
def _(spark, d):
    return W.technical(P.bars(spark, d))


@query("w13_technical_signal", "symbol date:d raw_signal:8 signal:8", "bars",
    TECHNICAL + f""", s0 as (select *, 2 * (dif - dea) as macd, row_number() {O}) as n, avg(close) {sql_frame(20)} as a20, avg(close) {sql_frame(60)} as a60, max(high) {sql_frame(20)} as x20, min(low) {sql_frame(20)} as i20 from te),
s1 as (select *, case when n >= 20 then a20 end as s20, case when n >= 60 then a60 end as s60, case when n >= 20 then x20 end as h20, case when n >= 20 then i20 end as l20 from s0),
s2 as (select symbol, date, (0.3e0 * case when rsi > 70 then -0.5e0 when rsi < 30 then 0.5e0 else (rsi - 50) / 20 end + 0.25e0 * case when macd > 0 and dif > dea then 0.3e0 when macd < 0 and dif < dea then -0.3e0 else 0e0 end
    + 0.25e0 * case when close > s20 and s20 > s60 then 0.3e0 when close < s20 and s20 < s60 then -0.3e0 else 0e0 end + 0.2e0 * case when close > h20 * 0.98e0 then 0.2e0 when close < l20 * 1.02e0 then -0.2e0 else 0e0 end)
    * case when atr > 0 then least(1, 0.02e0 / atr) else 1e0 end as raw_signal from s1)""",
    f"select *, avg(raw_signal) {sql_frame(5)} as signal from s2")
def _(spark, d):
    return W.technical_signal(W.technical(P.bars(spark, d)))


@query(
    "w14_trend_score",
    "symbol date:d trend_score",
    "ebars",
    f"x as (select *, row_number() {O}) as n, avg(close) {sql_frame(20)} as a, avg(close) {sql_frame(60)} as b, avg(close) {sql_frame(120)} as c from bars)".replace("bars", "ebars"),
    """select symbol, date, case when n < 120 then 0.0e0 when close > a and a > b and b > c then 1.0 when close > a and a > b then 0.5 when close > a then 0.3
    when close < a and a < b and b < c then -0.8 when close < a and a < b then -0.4 else 0.0 end as trend_score from x""",
)
def _(spark, d):
    return W.trend_score(P.events_bars(spark, d))


SYMBOLIC = f"""x as (select *, row_number() {O}) as n, lag(close) {O}) as p1, lag(close, 4) {O}) as c5, avg(close) {sql_frame(5)} as m5_, avg(close) {sql_frame(20)} as m20_, avg(close) {sql_frame(60)} as m60_,
    avg(close) {sql_frame(120)} as m120_, stddev_samp(close) {sql_frame(20)} as sd_, max(high) {sql_frame(20)} as h, min(low) {sql_frame(20)} as l, avg(volume) {sql_frame(20)} as v20 from bars),
y as (select *, case when n >= 120 then m120_ end as m120, m5_ as m5, m20_ as m20, m60_ as m60, case when n >= 20 then sd_ end as sd,
    avg(case when p1 is null then high - low else greatest(high - low, abs(high - p1), abs(low - p1)) end) {sql_frame(14)} as atr,
    case when c5 > 0 then close / c5 - 1 else 0 end as pc, case when v20 > 1e-9 then volume / v20 else 1 end as vc from x),
z as (select *, list(atr) {sql_frame(60)} as la from y)"""
SYMBOLIC_STATE = """select symbol, date, case when m120 is null then 'unknown' when close > m5 and m5 > m20 and m20 > m60 and m60 > m120 then 'bullish_full' when close > m20 and m20 > m60 and m60 > m120 then 'bullish_3'
    when close > m20 and m20 > m60 then 'bullish_2' when close < m5 and m5 < m20 and m20 < m60 and m60 < m120 then 'bearish_full' when close < m20 and m20 < m60 and m60 < m120 then 'bearish_3'
    when close < m20 and m20 < m60 then 'bearish_2' else 'ranging' end as alignment,
    case when sd > 0 then least(greatest((close - (m20 - 2 * sd)) / (4 * sd), 0), 1) else 0.5 end as bb_position, case when h > l then least(greatest((close - l) / (h - l), 0), 1) else 0.5 end as range_position,
    case when close >= h * 0.995 then 'resistance_break' when close <= l * 1.005 then 'support_break' else 'inside_range' end as breakout,
    case when n < 20 then 'unknown' when pc > 0.02 and vc > 1.3 then 'vol_breakout_bull' when pc > 0.02 and vc < 0.8 then 'vol_divergence_bear' when pc < -0.02 and vc > 1.3 then 'vol_breakout_bear'
    when pc < -0.02 and vc < 0.8 then 'shrink_consolidate' else 'vol_normal' end as volume_price,
    case when n >= 60 then len(list_filter(la, lambda a: a < atr)) / 60.0e0 else 0.5 end as atr_percentile from z"""


@query("w15_symbolic_state", "symbol date:d alignment bb_position:4 range_position:5 breakout volume_price atr_percentile:4", "bars", SYMBOLIC, SYMBOLIC_STATE)
def _(spark, d):
    return W.symbolic_state(P.bars(spark, d))


def scores_sql(c: str, table: dict[str, float]) -> str:
    return f"avg(case {c} " + " ".join(f"when '{k}' then {v}e0" for k, v in table.items()) + " else 0e0 end)"


@query("w16_market_state", "date:d symbols trend:8 volume:8 bb_position:6 breakout:8 composite:8 confidence:8", "bars", SYMBOLIC + f""", sy as ({SYMBOLIC_STATE}),
ms as (select date, count(*) as symbols, {scores_sql('alignment', W.ALIGN_SCORE)} as trend, {scores_sql('volume_price', W.VOLUME_SCORE)} as volume, avg(bb_position) as bb_position, {scores_sql('breakout', {'resistance_break': 1.0, 'support_break': -1.0})} as breakout from sy group by date),
mc as (select *, 0.5e0 * trend + 0.25e0 * volume + 0.25e0 * breakout as composite from ms)""", "select *, least(greatest(abs(composite) * 2, 0), 1) as confidence from mc")
def _(spark, d):
    return W.market_state(W.symbolic_state(P.bars(spark, d)))


@query(
    "w17_cross_trend",
    "symbol date:d state score:6 bull_ratio:6 bear_ratio:6 sr_position:6 volume_ratio:6",
    "bars",
    f"""x as (select *, row_number() {O}) as n, avg(close) {sql_frame(5)} as m5, avg(close) {sql_frame(10)} as m10, avg(close) {sql_frame(20)} as m20, avg(close) {sql_frame(30)} as m30, avg(close) {sql_frame(60)} as m60,
    max(high) {sql_frame(20)} as h, min(low) {sql_frame(20)} as l, avg(volume) {sql_frame(20)} as v from bars),
y as (select *, (m5 - m20) / m20 as a, (m10 - m30) / m30 as b, (m20 - m60) / m60 as c, case when h > l then least(greatest((close - l) / (h - l), 0), 1) else least(greatest(close - l, 0), 1) end as sr from x),
z as (select *, (a + b + c) / 3 as sc, (cast(a > 0.02 as int) + cast(b > 0.02 as int) + cast(c > 0.02 as int)) / 3.0e0 as bu, (cast(a < -0.02 as int) + cast(b < -0.02 as int) + cast(c < -0.02 as int)) / 3.0e0 as be from y)""",
    """select symbol, date, case when n < 60 then 'OSCILLATE' when abs(m5 - m20) < 0.01 and abs(m20 - m60) < 0.01 then 'REVERSION_WARNING' when sc > 0.02 and sr > 0.3 then 'UPTREND' when sc < -0.02 and sr < 0.7 then 'DOWNTREND' else 'OSCILLATE' end as state,
    case when n >= 60 then sc end as score, case when n >= 60 then bu end as bull_ratio, case when n >= 60 then be end as bear_ratio, case when n >= 60 then sr end as sr_position, case when n >= 60 then volume / v end as volume_ratio from z""",
)
def _(spark, d):
    return W.cross_trend(P.bars(spark, d))


FWD = f"""g as (select symbol, date, sum(ln(greatest(1 + coalesce(change_pct, 0) / 100, 1e-12))) {O} rows unbounded preceding) as s from bars),
fwd as (select symbol, date, exp(lead(s, 1) {O}) - s) - 1 as fwd_1, exp(lead(s, 5) {O}) - s) - 1 as fwd_5, exp(lead(s, 20) {O}) - s) - 1 as fwd_20 from g)"""


@query("w18_forward_returns", "symbol date:d fwd_1:6 fwd_5:6 fwd_20:6", "bars", FWD, "select * from fwd")
def _(spark, d):
    return W.forward_returns(P.bars(spark, d))


CAL = "cal as (select date, row_number() over (order by date) - 1 as idx, lag(date) over (order by date) as previous from (select distinct date from bars))"


@query(
    "w19_exact_labels",
    "symbol date:d horizon forward_return:6 valid reason",
    "ebars",
    CAL.replace("bars", "ebars") + """,
b as (select symbol, e.date, idx, (close / lag(close) over (partition by symbol order by e.date) - 1) * 100 as change_pct from ebars e join cal using (date)),
h as (select unnest([1, 3]) as horizon), last as (select max(idx) as top from cal),
x as (select b.symbol, b.date, b.idx, horizon, top, count(f.idx) as present, count(*) filter (f.change_pct > -100) as good, sum(ln(1 + f.change_pct / 100)) filter (f.change_pct > -100) as s
      from b cross join h cross join last left join b f on f.symbol = b.symbol and f.idx > b.idx and f.idx <= b.idx + horizon group by all),
y as (select *, case when idx + horizon > top then 'not_mature' when present < horizon then 'missing_future_bar' when good < horizon then 'invalid_change_pct' end as reason from x)""",
    "select symbol, date, cast(horizon as integer) as horizon, case when reason is null then exp(s) - 1 end as forward_return, reason is null as valid, reason from y",
)
def _(spark, d):
    b = P.events_bars(spark, d)
    b = b.withColumn("change_pct", (S.ratio(F.col("close"), F.lag("close").over(W.sym())) - 1) * 100)
    return W.exact_labels(b, P.calendar(b)).withColumn("forward_return", S.round_product("forward_return", 6))


@query(
    "w20_open_entry_labels",
    "symbol date:d label:6",
    "bars",
    "",
    f"""select symbol, date, case when count(*) {O} rows between 1 following and 2 following) = 2 then close / open * exp(sum(ln(1 + change_pct / 100)) {O} rows between 1 following and 2 following)) - 1 end as label from bars""",
)
def _(spark, d):
    return W.open_entry_labels(P.bars(spark, d))


def _feature_sql(c, w):
    ok = f"n >= {w} and count({c}) {sql_frame(w)} >= {w // 2 + 1}"
    return f"""case when {ok} then avg({c}) {sql_frame(w)} end as {c}_mean_{w}, case when {ok} then stddev_samp({c}) {sql_frame(w)} end as {c}_std_{w},
    case when {ok} then len(list_filter(list({c}) {sql_frame(w)}, lambda a: a <= {c})) / cast(count({c}) {sql_frame(w)} as double) end as {c}_rank_{w}"""


@query(
    "w30_rolling_features",
    "symbol date:d " + " ".join(f"{c}_{f}_{w}:{3 if c == 'close' else 6}" for c in ("close", "turnover") for w in (5, 20) for f in ("mean", "std", "rank")),
    "bars",
    f"x as (select *, row_number() {O}) as n from bars)",
    "select symbol, date, " + ", ".join(_feature_sql(c, w) for c in ("close", "turnover") for w in (5, 20)) + " from x",
)
def _(spark, d):
    return W.rolling_features(P.bars(spark, d), ["close", "turnover"])


@query(
    "w31_rank_percentile",
    "symbol date:d pct:8 cs_rank:8 demean:5 zscore:6",
    "bars",
    """x as (select *, rank() over (partition by date, turnover is null order by turnover) + (count(*) over (partition by date, turnover) - 1) / 2.0e0 as r, count(turnover) over (partition by date) as n,
    avg(turnover) over (partition by date) as m, stddev_samp(turnover) over (partition by date) as sd from bars)""",
    """select symbol, date, coalesce(case when n > 1 then (r - 1) / (n - 1) end, 0.5) as pct, r / n as cs_rank, turnover - m as demean, case when sd > 1e-12 then (turnover - m) / sd else 0 end as zscore from x""",
)
def _(spark, d):
    return P.bars(spark, d).select(
        "symbol", "date", S.rank_percentile("turnover", "date").alias("pct"), S.cs_rank("turnover", "date").alias("cs_rank"), S.cs_demean("turnover", "date").alias("demean"), S.cs_zscore("turnover", "date").alias("zscore")
    )


@query(
    "w34_winsorize",
    "symbol date:d win:5",
    "bars",
    "q as (select date, quantile_cont(change_pct, 0.01) as lo, quantile_cont(change_pct, 0.99) as hi from bars group by date)",
    "select symbol, b.date, case when change_pct is not null then least(greatest(change_pct, lo), hi) end as win from bars b join q using (date)",
)
def _(spark, d):
    return P.bars(spark, d).select("symbol", "date", S.winsorize("change_pct", "date").alias("win"))


@query(
    "w38_risk_factors",
    "symbol date:d std:6 cvar:6 drawdown:6 downside:6",
    "bars",
    f"""x as (select *, change_pct / 100 as r from bars),
y as (select *, list(r) filter (r is not null) {sql_frame(20)} as l, count(r) {sql_frame(20)} as n, stddev_samp(r) {sql_frame(20)} as sd from x),
z as (select *, list_transform(range(0, cast(n as int) + 1), lambda i: coalesce(list_reduce(list_prepend(1.0e0, l[1:i]), lambda a, b: a * (1 + b)), 1.0e0)) as nav from y)""",
    """select symbol, date, case when n >= 3 then sd end as std, case when n >= 3 then list_avg(list_sort(l)[1:greatest(cast(ceil(n * 0.05) as int), 1)]) end as cvar,
    case when n >= 3 then list_max(list_transform(range(1, len(nav) + 1), lambda i: 1 - nav[i] / list_max(nav[1:i]))) end as drawdown,
    case when n >= 3 then sqrt(list_sum(list_transform(l, lambda a: case when a < 0 then a * a else 0 end)) / n) end as downside from z""".replace("list(r) filter (r is not null)", "list(r) filter (r is not null)"),
)
def _(spark, d):
    return W.risk_factors(P.bars(spark, d).withColumn("ret", F.col("change_pct") / 100))


@query(
    "w39_expanding_zscore",
    "symbol date:d z:5",
    "bars",
    f"x as (select *, count(change_pct) {O} rows unbounded preceding) as n, avg(change_pct) {O} rows unbounded preceding) as m, stddev_samp(change_pct) {O} rows unbounded preceding) as sd from bars)",
    "select symbol, date, case when n >= 10 then case when sd > 1e-12 then least(greatest((change_pct - m) / sd, -5), 5) else 0 end else 0 end as z from x",
)
def _(spark, d):
    return W.expanding_zscore(P.bars(spark, d), "change_pct")


def halved_sql(a: str) -> str:
    return f"case when len({a}) >= 2 then [({a}[2 * i + 1] + {a}[2 * i + 2]) / 2 for i in range(len({a}) // 2)] else {a} end"


def last_sql(a: str) -> str:
    step = f"(len(x) // len({a}))"
    return f"case when (len(x) - 1) % {step} = 0 and (len(x) - 1) // {step} < len({a}) then {a}[(len(x) - 1) // {step} + 1] else 0 end"


@query("w40_haar_features", "symbol date:d trend_val:8 vol_val:8 trend_ratio:8 vol_ratio:8 energy_log:6", "bars",
    f"""h0 as (select symbol, date, list(close) {sql_frame(60)} as x0, row_number() {O}) as n, count(*) over (partition by symbol) as total from bars),
h1 as (select symbol, date, case when n >= 60 or (total < 60 and n = total and total >= 2) then x0 end as x from h0),
h2 as (select *, [(x[2 * i + 1] - x[2 * i + 2]) / 2 for i in range(len(x) // 2)] as det, {halved_sql('x')} as b1 from h1), h3 as (select *, {halved_sql('b1')} as b2 from h2), h4 as (select *, {halved_sql('b2')} as b3, list_sum([v * v for v in x]) + 1e-10 as en from h3),
h5 as (select symbol, date, {last_sql('b3')} as trend_val, {last_sql('det')} as vol_val, list_sum([v * v for v in b3]) / en as trend_ratio, list_sum([v * v for v in det]) / en as vol_ratio, ln(1 + en) as energy_log from h4)""",
    "select symbol, date, coalesce(trend_val, 0) as trend_val, coalesce(vol_val, 0) as vol_val, coalesce(trend_ratio, 0) as trend_ratio, coalesce(vol_ratio, 0) as vol_ratio, coalesce(energy_log, 0) as energy_log from h5")
def _(spark, d):
    return W.haar_features(P.bars(spark, d))


@query(
    "w46_fill_change",
    "symbol date:d change_pct:5",
    "bars",
    f"x as (select symbol, date, close, case when volume % 3 != 0 then change_pct end as chg, lag(close) {O}) as p from bars)",
    "select symbol, date, coalesce(chg, case when p > 0 and close > 0 then round((close - p) / p * 100, 4) end) as change_pct from x",
)
def _(spark, d):
    return W.fill_change(P.bars(spark, d).withColumn("change_pct", F.when(F.col("volume") % 3 != 0, F.col("change_pct"))))


@query("w47_sessions", "date:d idx previous:d", "bars", CAL, "select date, cast(idx as integer) as idx, previous from cal")
def _(spark, d):
    return P.calendar(P.bars(spark, d))


@query(
    "w53_trailing_stop",
    "symbol date:d line:3 breach first_breach:d",
    "bars",
    f"""x as (select *, first(close) {O} rows unbounded preceding) as entry, max(close) {O} rows unbounded preceding) as peak from bars),
y as (select *, greatest(least(entry * (1 - 0.08), entry * (1 - 0.12)), peak * (1 - 0.1)) as line from x), z as (select *, close <= line as breach from y)""",
    "select symbol, date, line, breach, min(case when breach then date end) over (partition by symbol) as first_breach from z",
)
def _(spark, d):
    b = P.bars(spark, d).withColumn("entry", F.first("close").over(W.sym().rowsBetween(W.Window.unboundedPreceding, 0))).withColumn("price", F.col("close"))
    return W.trailing_stop(b, hard_floor=0.12)


@query(
    "f12_operators",
    "symbol date:d tmean:3 trank:6 tz:5 delta:3 div:6 logv:6 inv:8 score:6",
    "bars",
    f"x as (select *, row_number() {O}) as n, lag(close, 3) {O}) as p3, avg(close) {sql_frame(10)} as m, stddev_samp(close) {sql_frame(10)} as sd, list(close) {sql_frame(10)} as l from bars)",
    """select symbol, date, case when n >= 10 then m end as tmean, case when n >= 10 then len(list_filter(l, lambda a: a <= close)) / 10.0e0 end as trank, case when n >= 10 then case when sd > 1e-12 then (close - m) / sd else 0 end end as tz,
    close - p3 as delta, case when abs(change_pct) > 1e-9 then turnover / change_pct end as div, case when abs(change_pct) > 1e-9 then ln(abs(change_pct)) end as logv, case when abs(close) > 1e-9 then 1 / close end as inv,
    case when change_pct is null then 0.5 else least(greatest((change_pct + 20) / 40, 0), 1) end as score from x""",
)
def _(spark, d):
    c = F.col("change_pct")
    return P.bars(spark, d).select(
        "symbol", "date", S.ts("mean", "close", 10).alias("tmean"), S.ts("rank", "close", 10).alias("trank"), S.ts("zscore", "close", 10).alias("tz"), S.ts_delta("close", 3).alias("delta"),
        S.safe_div(F.col("turnover"), c).alias("div"), S.safe_log(c).alias("logv"), S.safe_inv(F.col("close")).alias("inv"), S.clip_score(c, -20, 20).alias("score"),
    )
