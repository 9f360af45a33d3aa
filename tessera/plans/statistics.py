"""Queries over control charts, regimes, gates and overfitting statistics."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tessera.operators import statistics as T
from tessera.operators import windows as W
from tessera.plans.registry import query
from tessera.plans.windows import FWD
from tessera.sources import panels as P

SERIES = "se as (select symbol as indicator, date, turnover as value from bars)"


def series(spark, d):
    return P.bars(spark, d).select(F.col("symbol").alias("indicator"), "date", F.col("turnover").alias("value"))


WIN = "window w as (partition by indicator order by date)"


@query("w48_control_limits", "indicator date:d mean:6 ucl:5 lcl:5", "bars", SERIES, "select indicator, date, avg(value) over w as mean, avg(value) over w + 3 * stddev_samp(value) over w as ucl, avg(value) over w - 3 * stddev_samp(value) over w as lcl from se window w as (partition by indicator order by date rows between 19 preceding and current row)")
def _(spark, d):
    return T.control_limits(series(spark, d))


RULES = SERIES + f""", r0 as (select *, avg(value) over (partition by indicator) as m, stddev_samp(value) over (partition by indicator) as s, lag(value) over w as p from se {WIN}),
r1 as (select indicator, date, value, abs(sum(sign(value - m)) over (w rows between 8 preceding and current row)) = 9 as same_side_9, abs(sum(sign(value - p)) over (w rows between 5 preceding and current row)) = 6 as monotone_6,
    sum(cast(value > m + s as int)) over (w rows between 4 preceding and current row) >= 4 or sum(cast(value < m - s as int)) over (w rows between 4 preceding and current row) >= 4 as beyond_4_of_5, sum(cast(abs(value - m) > s as int)) over (w rows between 7 preceding and current row) = 8 as beyond_8 from r0 {WIN})"""


@query("w49_run_rules", "indicator date:d same_side_9 monotone_6 beyond_4_of_5 beyond_8", "bars", RULES, "select * from r1")
def _(spark, d):
    return T.we_rules(series(spark, d))


CUSUM = f""", cu0 as (select indicator, date, s, sum(value - m - 0.5e0 * s) over (w rows unbounded preceding) as u, sum(m - value - 0.5e0 * s) over (w rows unbounded preceding) as v from r0 {WIN}),
cu as (select indicator, date, u - least(0, min(u) over (w rows unbounded preceding)) as cusum_up, v - least(0, min(v) over (w rows unbounded preceding)) as cusum_down, s from cu0 {WIN})"""


@query("w50_cusum", "indicator date:d cusum_up:5 cusum_down:5 alarm", "bars", RULES + CUSUM, "select *, greatest(cusum_up, cusum_down) > 4 * s as alarm from cu")
def _(spark, d):
    return T.cusum(series(spark, d))


@query("w51_pinning", "indicator date:d hits pinned", "bars", SERIES + ", h as (select indicator, date, cast(sum(cast(abs(value - 6) <= 1.5 as int)) over (partition by indicator order by date rows between 9 preceding and current row) as bigint) as hits from se)", "select *, hits >= 6 as pinned from h")
def _(spark, d):
    return T.pinned(series(spark, d), 6.0, tol=1.5)


@query("w52_spc_levels", "indicator date:d level", "bars",
    RULES + CUSUM + ", cl as (select indicator, date, value, avg(value) over w + 3 * stddev_samp(value) over w as ucl, avg(value) over w - 3 * stddev_samp(value) over w as lcl from se window w as (partition by indicator order by date rows between 19 preceding and current row)), pin as (select indicator, date, sum(cast(abs(value - 6) <= 0.01 as int)) over (partition by indicator order by date rows between 9 preceding and current row) >= 6 as pinned from se)",
    "select cl.indicator, cl.date, case when cl.value > ucl or cl.value < lcl then 'P0' when greatest(cusum_up, cusum_down) > 4 * s then 'P1' when same_side_9 or coalesce(monotone_6, false) or beyond_4_of_5 or beyond_8 then 'P2' when pinned then 'P3' else 'OK' end as level from cl join cu using (indicator, date) join r1 using (indicator, date) join pin using (indicator, date)")
def _(spark, d):
    return T.spc_level(series(spark, d), 6.0)


MARKET = "mk as (select date, avg(change_pct) / 2000 as ret from bars where change_pct is not null group by date)"


def market(spark, d):
    return P.bars(spark, d).where("change_pct is not null").groupBy("date").agg((F.avg("change_pct") / 2000).alias("ret"))


REGIME = MARKET + """, rg as (select date, count(ret) over w as n, exp(sum(ln(1 + ret)) over w) - 1 as trend, stddev_samp(ret) over w * sqrt(252) as vol from mk window w as (order by date rows between 19 preceding and current row)),
regime as (select date, trend, vol, case when n < 20 then 'unknown' when vol > 0.3 then 'high_vol' when trend > 0.05 then 'bull' when trend < -0.05 then 'bear' else 'sideways' end as regime from rg)"""


@query("w41_market_regime", "date:d trend:7 vol:7 regime", "bars", REGIME, "select * from regime")
def _(spark, d):
    return T.market_regime(market(spark, d))


@query("b89_regime_share", "year regime n share:8", "bars", REGIME + ", c as (select year(date) as year, regime, count(*) as n from regime group by 1, 2)", "select cast(year as integer) as year, regime, n, n / cast(sum(n) over (partition by year) as double) as share from c")
def _(spark, d):
    x = T.market_regime(market(spark, d)).groupBy(F.year("date").alias("year"), "regime").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(W.Window.partitionBy("year")))


CURVE = "cr as (select left(symbol, 5) as curve_id, date, avg(change_pct) / 100 as ret from bars where change_pct is not null group by 1, 2)"


def curve(spark, d):
    return P.bars(spark, d).where("change_pct is not null").groupBy(F.substring("symbol", 1, 5).alias("curve_id"), "date").agg((F.avg("change_pct") / 100).alias("ret"))


@query("w42_sharpe_change", "curve_id n swing:5 jump:5 change_point", "bars",
    CURVE + """, s0 as (select curve_id, date, case when count(ret) over w >= 20 then avg(ret) over w / stddev_samp(ret) over w * sqrt(252) end as sharpe from cr window w as (partition by curve_id order by date rows between 19 preceding and current row)),
s1 as (select *, abs(sharpe - lag(sharpe, 10) over (partition by curve_id order by date)) as swing, abs(sharpe - lag(sharpe) over (partition by curve_id order by date)) as j, row_number() over (partition by curve_id order by date desc) as k from s0 where sharpe is not null),
s2 as (select curve_id, count(*) as n, max(swing) as swing, max(j) filter (k <= 5) as jump, avg(j) as m, stddev_samp(j) as s from s1 group by 1)""",
    "select curve_id, n, swing, jump, jump > greatest(1, m + 2 * s) as change_point from s2")
def _(spark, d):
    return T.sharpe_change(curve(spark, d))


def strategy_ics(spark, d):
    b = P.bars(spark, d)
    x = b.join(W.forward_returns(b, (1,)), ["symbol", "date"]).withColumn("strategy_id", F.col("symbol").cast("int") % 5)
    from tessera.operators.ic import pearson_ic

    return pearson_ic(x.withColumnRenamed("turnover", "value").withColumnRenamed("fwd_1", "label"), ["strategy_id", "date"]).where("ic is not null")


STATS = FWD + """, si as (select cast(symbol as integer) % 5 as strategy_id, b.date, corr(turnover, fwd_1) as ic from bars b join fwd using (symbol, date) where fwd_1 is not null group by 1, 2 having stddev_pop(turnover) > 1e-12 and stddev_pop(fwd_1) > 1e-12),
rr0 as (select strategy_id, date, avg(ic) over w as m, avg(cast(ic < 0 as double)) over w as neg, stddev_samp(ic) over w as s from si window w as (partition by strategy_id order by date rows between 19 preceding and current row)),
rr as (select strategy_id, date, m, neg, case when abs(s) > 1e-12 then m / s end as ir from rr0)"""
RAW = "case when m is null then 'unknown' when m < {mean} and neg > {neg} and coalesce(ir < 0, true) then 'risk' when m >= 0.02 then 'normal' else 'caution' end"
RAWS = STATS + f", raws as (select strategy_id, date, {RAW.format(mean=0, neg=0.55)} as raw from rr)"


@query("w44_raw_regime", "strategy_id date:d raw", "bars", RAWS, "select * from raws")
def _(spark, d):
    return T.raw_regime(strategy_ics(spark, d))


def gate_sql(source: str, keys: str, enter: str, leave: str, date: str = "date") -> str:
    """CTEs up to ``gate``: the states of a table of raw ones after confirmation."""
    w = f"over (partition by {keys} order by {date} rows between unbounded preceding and"
    return f"""g0 as (select *, case when raw in ('normal', 'caution', 'risk') then cast(raw = 'risk' as int) end as rk from {source}),
g1 as (select *, last_value(rk ignore nulls) {w} 1 preceding) as pr from g0),
g2 as (select *, sum(cast(rk is not null and rk is distinct from pr as int)) {w} current row) as isl from g1),
g3 as (select *, count(rk) over (partition by {keys}, isl order by {date} rows unbounded preceding) as run from g2),
g4 as (select *, case when rk = 1 and run >= {enter} then 1 when rk = 0 and run >= {leave} then 0 end as ev from g3),
gate as (select *, case when rk is null then raw when coalesce(last_value(ev ignore nulls) {w} current row), 0) = 1 then 'risk' when rk = 1 then 'caution' else raw end as regime from g4)"""


@query("w44_gate", "strategy_id date:d raw regime", "bars", RAWS + ",\n" + gate_sql("raws", "strategy_id", "2", "3"), "select strategy_id, date, raw, regime from gate")
def _(spark, d):
    return T.hysteresis(T.raw_regime(strategy_ics(spark, d)), 2, 3)


KEYS = "strategy_id, config_id"
CURVES = f"""c0 as (select *, coalesce(lag(case regime when 'risk' then risk_exposure when 'caution' then caution_exposure else 1.0e0 end) over (partition by {KEYS} order by date), 1) as held from gate),
c1 as (select *, coalesce(abs(held - lag(held) over (partition by {KEYS} order by date)), 0) as shift from c0),
c2 as (select *, held * coalesce(ret, 0) - shift * 10 / 1e4 as net, coalesce(ret, 0) as r from c1),
c3 as (select *, exp(sum(ln(1 + net)) over (partition by {KEYS} order by date rows unbounded preceding)) as equity, exp(sum(ln(1 + r)) over (partition by {KEYS} order by date rows unbounded preceding)) as plain from c2),
curves as (select *, 1 - equity / max(equity) over (partition by {KEYS} order by date rows unbounded preceding) as fall, 1 - plain / max(plain) over (partition by {KEYS} order by date rows unbounded preceding) as plain_fall from c3)"""


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


REPLAYED = [(i, e, x, r, c) for i, (e, x, r, c) in enumerate([(1, 1, 0.0, 0.5), (2, 3, 0.2, 0.7), (3, 3, 0.3, 0.8), (3, 5, 0.0, 1.0)])]


@query("b43_gate_replay", "strategy_id config_id days total:6 max_drawdown:6 mean_exposure:6 shifts", "bars",
    RAWS + ",\n" + MARKET + f", grid(config_id, enter, leave, risk_exposure, caution_exposure) as (values {values(REPLAYED)}), dd as (select * from mk join raws using (date) cross join grid),\n" + gate_sql("dd", KEYS, "enter", "leave") + ",\n" + CURVES,
    f"select strategy_id, config_id, count(*) as days, max_by(equity, date) - 1 as total, max(fall) as max_drawdown, avg(held) as mean_exposure, count(*) filter (shift > 0) as shifts from curves group by {KEYS}")
def _(spark, d):
    grid = spark.createDataFrame(REPLAYED, "config_id int, enter int, leave int, risk_exposure double, caution_exposure double")
    return T.gate_replay(market(spark, d), T.raw_regime(strategy_ics(spark, d)), grid)


def tried_sql(rows: list[tuple]) -> str:
    return f"""{STATS},
{MARKET}, grid(config_id, param, value, risk_mean, risk_neg, risk_exposure, caution_exposure, hysteresis) as (values {values(rows)}),
dd as (select *, {RAW.format(mean='risk_mean', neg='risk_neg')} as raw from mk join rr using (date) cross join grid),
{gate_sql('dd', KEYS, 'hysteresis', 'hysteresis')},
{CURVES},
tried as (select strategy_id, config_id, param, value, case when stddev_samp(net) > 1e-12 then avg(net) / stddev_samp(net) * sqrt(252) end - case when stddev_samp(r) > 1e-12 then avg(r) / stddev_samp(r) * sqrt(252) end as sharpe_diff,
    (pow(max_by(equity, date), 252.0e0 / count(*)) - pow(max_by(plain, date), 252.0e0 / count(*))) * 100 as growth_diff, (max(plain_fall) - max(fall)) * 100 as drawdown_gain, avg(cast(regime = 'risk' as double)) as risk_share, avg(held) as mean_exposure
    from curves group by 1, 2, 3, 4)"""


def tried(spark, d, rows):
    return T.gate_sensitivity(market(spark, d), strategy_ics(spark, d), spark.createDataFrame(rows, T.GATE_SCHEMA))


@query("b43_gate_sensitivity", "strategy_id param n sharpe_spread:6 growth_spread:5 rank", "bars", tried_sql(T.one_at_a_time()),
    """select *, cast(row_number() over (partition by strategy_id order by round(sharpe_spread, 7) desc nulls last, param) as integer) as rank
    from (select strategy_id, param, count(*) as n, max(sharpe_diff) - min(sharpe_diff) as sharpe_spread, max(growth_diff) - min(growth_diff) as growth_spread from tried group by 1, 2)""")
def _(spark, d):
    return T.gate_spread(tried(spark, d, T.one_at_a_time()))


@query("b43_gate_grid", "strategy_id config_id sharpe_diff:6 growth_diff:5 drawdown_gain:5 risk_share:8 mean_exposure:8 passes", "bars", tried_sql(T.sampled()),
    "select *, coalesce(sharpe_diff > -0.05 and drawdown_gain >= 0.5 and risk_share between 0.15 and 0.25 and growth_diff > -2, false) as passes from tried")
def _(spark, d):
    return T.gate_passes(tried(spark, d, T.sampled()))


@query("b44_degradation", "strategy_id consistency:6 activity:6 skew:6 decline:6 index:4 level", "bars",
    """pf as (select cast(symbol as integer) % 5 as strategy_id, date, avg(change_pct) / 100 as ret, sum(volume) as trades from bars where change_pct is not null group by 1, 2),
px as (select *, row_number() over (partition by strategy_id order by date) - 1 as i, count(*) over (partition by strategy_id) as n from pf),
pm as (select strategy_id, avg(ret) filter (i * 2 < n) as m0, avg(ret) filter (i * 2 >= n) as m1, avg(ret) filter (i * 2 < n) as a0, stddev_samp(ret) as s, sum(trades) filter (i * 2 < n) as t0, sum(trades) filter (i * 2 >= n) as t1,
    regr_slope(ret, i) as slope, count(*) filter (i * 2 < n) as n0, count(*) filter (i * 2 >= n) as n1, stddev_pop(ret) filter (i * 2 < n) as s0, stddev_pop(ret) filter (i * 2 >= n) as s1 from px group by 1),
pk as (select p.strategy_id, avg(pow(ret - m0, 3)) filter (i * 2 < n) / pow(any_value(s0), 3) as k0, avg(pow(ret - m1, 3)) filter (i * 2 >= n) / pow(any_value(s1), 3) as k1 from px p join pm using (strategy_id) group by 1),
pc as (select strategy_id, case when s > 1e-9 then least(greatest((m0 - m1) / s, 0), 1) else 0 end as consistency, least(greatest(1 - case when abs(t0) > 1e-9 then t1 / t0 else 1 end, 0), 1) as activity,
    least(abs(k1 - k0) / 2, 1) as skew, case when s > 1e-9 then least(greatest(-slope * 100 / s, 0), 1) else 0 end as decline from pm join pk using (strategy_id)),
pi as (select *, 100 * (0.35e0 * consistency + 0.2e0 * activity + 0.2e0 * skew + 0.25e0 * decline) as index from pc)""",
    "select *, case when index >= 60 then 'severe' when index >= 30 then 'warning' else 'ok' end as level from pi")
def _(spark, d):
    x = P.bars(spark, d).withColumn("strategy_id", F.col("symbol").cast("int") % 5).where("change_pct is not null")
    return T.degradation(x.groupBy("strategy_id", "date").agg((F.avg("change_pct") / 100).alias("ret"), F.sum("volume").alias("trades")))


@query("b45_weight_drift", "factor days day_over_day:8 from_first:8 autocorr:6 drifted", "bars",
    "wf as (select left(symbol, 5) as factor, date, sum(turnover) as t from bars group by 1, 2), wn as (select factor, date, t / sum(t) over (partition by date) as weight from wf), wl as (select *, lag(weight) over (partition by factor order by date) as p, first(weight) over (partition by factor order by date) as f from wn)",
    "select factor, count(*) as days, max(abs(weight - p)) as day_over_day, max(abs(weight - f)) as from_first, case when stddev_pop(p) > 1e-12 then corr(weight, p) end as autocorr, max(abs(weight - p)) > 0.1 as drifted from wl group by factor")
def _(spark, d):
    x = P.bars(spark, d).groupBy(F.substring("symbol", 1, 5).alias("factor"), "date").agg(F.sum("turnover").alias("t"))
    return T.weight_drift(x.select("factor", "date", (F.col("t") / F.sum("t").over(W.Window.partitionBy("date"))).alias("weight")))


@query("b46_risk_explained", "symbol n r2:6", "bars", MARKET + """, rx as (select symbol, change_pct / 100 as y, ret as a, turnover as b from bars join mk using (date) where change_pct is not null and ret is not null and turnover is not null),
rm as (select symbol, count(*) as n, covar_pop(y, a) as ya, covar_pop(y, b) as yb, covar_pop(a, b) as ab, var_pop(a) as aa, var_pop(b) as bb, var_pop(y) as yy from rx group by 1)""",
    "select symbol, n, case when yy * n > 1e-18 and n > 3 then ((ya * bb - yb * ab) / (aa * bb - ab * ab) * ya + (yb * aa - ya * ab) / (aa * bb - ab * ab) * yb) / yy end as r2 from rm")
def _(spark, d):
    x = P.bars(spark, d).join(market(spark, d).withColumnRenamed("ret", "mkt"), "date").withColumn("ret", F.col("change_pct") / 100)
    return T.risk_explained(x, "ret", ["mkt", "turnover"], "symbol")


@query("b46_single_factor_r2", "symbol r2:6", "bars", MARKET, "select symbol, regr_r2(change_pct / 100, ret) as r2 from bars join mk using (date) group by symbol")
def _(spark, d):
    x = P.bars(spark, d).join(market(spark, d).withColumnRenamed("ret", "mkt"), "date")
    return x.groupBy("symbol").agg(F.regr_r2(F.col("change_pct") / 100, F.col("mkt")).alias("r2"))


def config_blocks(spark, d):
    b = P.bars(spark, d)
    blocks = P.calendar(b.where("change_pct is not null")).select("date", F.least(F.floor(F.col("idx") / 11), F.lit(7)).cast("int").alias("block"))
    return b.where("change_pct is not null").join(F.broadcast(blocks), "date").select("block", (F.col("symbol").cast("int") % 10).alias("config"), (F.col("change_pct") / 100).alias("ret"))


PBO = """bl as (select cast(least((dense_rank() over (order by date) - 1) // 11, 7) as integer) as block, cast(symbol as integer) % 10 as config, change_pct / 100 as ret from bars where change_pct is not null),
mo as (select block, config, count(ret)::double as n, sum(ret) as s, sum(ret * ret) as q from bl group by 1, 2), bb as (select unnest(range(0, 256)) as mask), hv as (select mask from bb where bit_count(mask::integer) = 4),
xs as (select mask, config, (mask >> block) & 1 = 1 as inside, sum(n) as n, sum(s) as s, sum(q) as q from mo cross join hv group by 1, 2, 3),
sr as (select mask, config, inside, case when (q - s * s / n) / (n - 1) > 1e-18 then s / n / sqrt((q - s * s / n) / (n - 1)) else 0 end as sr from xs),
io as (select mask, config, max(sr) filter (inside) as is_sr, max(sr) filter (not inside) as oos_sr from sr group by 1, 2),
rk as (select *, row_number() over (partition by mask order by is_sr desc, config) as best, rank() over (partition by mask order by oos_sr) as r, count(*) over (partition by mask) as n from io),
fi as (select *, r / (n + 1.0e0) as omega, ln(r / (n + 1.0e0) / (1 - r / (n + 1.0e0))) as lam from rk where best = 1)"""


@query("b47_cscv_pbo", "combos pbo:8 lambda_mean:7 omega_mean:7 slope:5 loss_prob:8", "bars", PBO, "select count(*) as combos, avg(cast(lam < 0 as double)) as pbo, avg(lam) as lambda_mean, avg(omega) as omega_mean, regr_slope(oos_sr, is_sr) as slope, avg(cast(oos_sr < 0 as double)) as loss_prob from fi")
def _(spark, d):
    return T.cscv_pbo(config_blocks(spark, d))


def blocks_sql(k: int) -> str:
    return f"""cc as (select date, row_number() over (order by date) - 1 as i from (select distinct date from ebars)), cn as (select *, count(*) over () as n from cc),
iv as (select i, date as t0, date + 2 as t1, n, case when i < n % {k} * (n // {k} + 1) then i // (n // {k} + 1) else n % {k} + (i - n % {k} * (n // {k} + 1)) // (n // {k}) end as own from cn)"""


@query("b47_cscv_metric", "combos pbo:8 lambda_mean:7 omega_mean:7 slope:5 loss_prob:8", "bars", """bl as (select cast(least((dense_rank() over (order by date) - 1) // 11, 7) as integer) as block, cast(symbol as integer) % 10 as config, change_pct / 100 as ret from bars where change_pct is not null),
bb as (select unnest(range(0, 256)) as mask), hv as (select mask from bb where bit_count(mask::integer) = 4),
sr as (select mask, config, (mask >> block) & 1 = 1 as inside, round(avg(cast(ret > 0 as double)), 12) as sr from bl cross join hv group by 1, 2, 3),
io as (select mask, config, max(sr) filter (inside) as is_sr, max(sr) filter (not inside) as oos_sr from sr group by 1, 2),
rk as (select *, row_number() over (partition by mask order by is_sr desc, config) as best, rank() over (partition by mask order by oos_sr) + (count(*) over (partition by mask, oos_sr) - 1) / 2.0e0 as r, count(*) over (partition by mask) as n from io),
fi as (select *, r / (n + 1.0e0) as omega, ln(r / (n + 1.0e0) / (1 - r / (n + 1.0e0))) as lam from rk where best = 1)""",
    "select count(*) as combos, avg(cast(lam < 0 as double)) as pbo, avg(lam) as lambda_mean, avg(omega) as omega_mean, regr_slope(oos_sr, is_sr) as slope, avg(cast(oos_sr < 0 as double)) as loss_prob from fi")
def _(spark, d):
    return T.cscv_pbo(config_blocks(spark, d), metric=lambda r: F.round(F.avg((r > 0).cast("double")), 12))


@query("b49_purged_folds", "fold i role", "ebars", blocks_sql(5) + """,
sp as (select own as fold, min(t0) as a, max(t1) as b, max(i) as last from iv group by own)""",
    "select cast(fold as integer) as fold, cast(i as integer) as i, case when own = fold then 'test' when t0 <= b and t1 >= a then 'purged' when i > last and i <= last + floor(n * 0.15) then 'embargo' else 'train' end as role from iv cross join sp")
def _(spark, d):
    c = P.calendar(P.events_bars(spark, d)).select(F.col("idx").alias("i"), F.col("date").alias("t0"), F.date_add("date", 2).alias("t1"))
    return T.purged_folds(c, 5, 0.15)


@query("b49_cpcv", "combo i role block paths", "ebars", blocks_sql(6) + """, sp as (select own as block, min(t0) as a, max(t1) as b, max(i) as last from iv group by own),
cb as (select row_number() over (order by x.block, y.block) - 1 as combo, x.block as p, y.block as q, x.a as pa, x.b as pb, y.a as qa, y.b as qb, greatest(x.last, y.last) as last from sp x join sp y on x.block < y.block)""",
    """select cast(combo as integer) as combo, cast(i as integer) as i, case when own in (p, q) then 'test' when (t0 <= pb and t1 >= pa) or (t0 <= qb and t1 >= qa) then 'purged' when i > last and i <= last + floor(n * 0.1) then 'embargo' else 'train' end as role,
    cast(own as integer) as block, cast(5 as integer) as paths from iv cross join cb""")
def _(spark, d):
    c = P.calendar(P.events_bars(spark, d)).select(F.col("idx").alias("i"), F.col("date").alias("t0"), F.date_add("date", 2).alias("t1"))
    return T.cpcv(c, 6, 2, 0.1).withColumn("paths", F.lit(T.cpcv_paths(6, 2)))


def cdf_sql(z: str) -> str:
    """The series that ``normal_cdf`` uses."""
    t = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2)))"
    poly = "0.17087277e0"
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {t} + {a}e0)"
    half = f"{t} * exp(-({z}) * ({z}) / 2 + {poly}) / 2"
    return f"case when {z} >= 0 then 1 - {half} else {half} end"


ND, GAMMA = NormalDist(), 0.5772156649015329
FACTOR = (1 - GAMMA) * ND.inv_cdf(1 - 1 / 10) + GAMMA * ND.inv_cdf(1 - 1 / (10 * 2.718281828459045))


@query("b50_sharpe_tests", "curve_id n sharpe:6 skew:5 kurt:5 psr:4 dsr:4 min_track:2", "bars", CURVE + f""", c0 as (select curve_id, ret, count(*) over w as n, avg(ret) over w as m, stddev_samp(ret) over w as s, stddev_pop(ret) over w as sp from cr window w as (partition by curve_id)),
c1 as (select curve_id, any_value(n) as n, case when any_value(s) > 1e-12 then any_value(m) / any_value(s) end as sharpe, avg(pow(ret - m, 3)) / pow(any_value(sp), 3) as skew, avg(pow(ret - m, 4)) / pow(any_value(sp), 4) as kurt from c0 group by curve_id),
c2 as (select *, greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-12) as v, coalesce(stddev_samp(sharpe) over (), 0) * {FACTOR!r}e0 as best from c1),
c3 as (select *, sharpe * sqrt(n - 1) / sqrt(v) as z0, (sharpe - best) * sqrt(n - 1) / sqrt(v) as z1 from c2)""",
    f"select curve_id, n, sharpe, skew, kurt, {cdf_sql('z0')} as psr, {cdf_sql('z1')} as dsr, case when sharpe > 0 then 1 + v * pow({ND.inv_cdf(0.95)!r}e0 / sharpe, 2) end as min_track from c3")
def _(spark, d):
    return T.sharpe_tests(curve(spark, d))


@query("b51_sign_flip", "group patterns mean:7 p_greater:8 p_two_sided:8", "bars", CURVE + """, gx as (select curve_id, x, row_number() over (partition by curve_id order by y) - 1 as i from (select curve_id, year(date) as y, sum(ret) as x from cr group by 1, 2)), gn as (select curve_id, count(*) as n, avg(x) as m from gx group by 1),
pt as (select curve_id, n, m, unnest(range(0, cast(pow(2, n) as bigint))) as p from gn), sm as (select gx.curve_id, p, any_value(m) as m, avg(x * (1 - 2 * ((p >> i) & 1))) as s from gx join pt using (curve_id) group by 1, 2)""",
    'select curve_id as "group", count(*) as patterns, any_value(m) as mean, avg(cast(s >= m - 1e-12 as double)) as p_greater, avg(cast(abs(s) >= abs(m) - 1e-12 as double)) as p_two_sided from sm group by 1')
def _(spark, d):
    x = curve(spark, d).groupBy(F.col("curve_id").alias("group"), F.year("date").alias("k")).agg(F.sum("ret").alias("x"))
    return T.sign_flip(x)


@query("b51_sign_flip_whole", "group n patterns mean:7 p_greater:8 p_two_sided:8")
def _(spark, d):
    x = curve(spark, d).select(F.col("curve_id").alias("group"), F.col("date").alias("k"), F.col("ret").alias("x"))
    return T.sign_flip(x).join(x.groupBy("group").agg(F.count("x").alias("n")), "group")


@query("b52_robust_max_z", "group median:7 mad:7 max_z:5", "bars", CURVE + ", md as (select curve_id, ret as x, median(ret) over (partition by curve_id) as m from cr), g as (select curve_id, any_value(m) as median, median(abs(x - m)) as mad, max(x) as top, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr from md group by 1)",
    'select curve_id as "group", median, mad, (top - median) / case when mad > 1e-12 then mad * 1.4826e0 when iqr > 1e-12 then iqr / 1.349e0 end as max_z from g')
def _(spark, d):
    return T.robust_max_z(curve(spark, d).select(F.col("curve_id").alias("group"), F.col("ret").alias("x")))


@query("b53_parameter_stability", "curve_id cv:6 spread:7", "bars", CURVE, "select curve_id, stddev_samp(ret) / abs(avg(ret)) as cv, max(ret) - min(ret) as spread from cr group by 1")
def _(spark, d):
    return curve(spark, d).groupBy("curve_id").agg((F.stddev_samp("ret") / F.abs(F.avg("ret"))).alias("cv"), (F.max("ret") - F.min("ret")).alias("spread"))
