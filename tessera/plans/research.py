"""Queries over the research stages and the stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ic, xsec
from tessera.operators import relational as R
from tessera.operators import research as X
from tessera.operators import statistics as T
from tessera.operators import windows as W
from tessera.plans.evaluation import COMPOSITE, IC, LEAST, LONG, SUMMARY, composite_panel, daily_ics, scores_long
from tessera.plans.registry import query
from tessera.plans.windows import FWD
from tessera.sources import panels as P
from tessera.sources import stores
from tessera.sources.scratch import shared_folder, written

SM = IC + f", sm as ({SUMMARY.format('ic')})"


@query("b02_factor_screen", "factor ic_ok icir_ok t_ok passed", "bars", SM + ", gg as (select factor, abs(ic_mean) >= 0.02 as ic_ok, abs(icir) >= 0.3 as icir_ok, abs(t_value) >= 2 as t_ok from sm)", "select *, ic_ok and icir_ok and t_ok as passed from gg")
def _(spark, d):
    return X.screen(ic.ic_summary(daily_ics(spark, d), ["factor"]))


WEIGHTS = [("mom20", -0.5), ("vol20", 0.2), ("f_liquidity", 0.3)]
FUSED = LONG + """, fz as (select date, symbol, factor, case when stddev_samp(value) over w > 1e-12 then (value - avg(value) over w) / stddev_samp(value) over w else 0 end as z from long where value is not null window w as (partition by date, factor)),
fw(factor, weight) as (values ('mom20', -0.5e0), ('vol20', 0.2e0), ('f_liquidity', 0.3e0)), fr as (select date, symbol, sum(weight * z) / sum(abs(weight)) as raw from fz join fw using (factor) group by 1, 2),
fused as (select date, symbol, case when stddev_samp(raw) over w > 1e-12 then (raw - avg(raw) over w) / stddev_samp(raw) over w else 0 end as score from fr window w as (partition by date))"""


def fused(spark, d):
    return X.fuse(scores_long(spark, d), spark.createDataFrame(WEIGHTS, "factor string, weight double"))


@query("b07_fused_scores", "date:d symbol score:6", "bars", FUSED, "select * from fused")
def _(spark, d):
    return fused(spark, d)


@query("b82_target_plan", "date:d symbol rank", "bars", FUSED, "select date, symbol, cast(row_number() over (partition by date order by round(score, 9) desc, symbol) as integer) as rank from fused qualify rank <= 8")
def _(spark, d):
    return R.top_n(fused(spark, d).withColumn("score", F.round("score", 9)), "score", 8, "date")


@query("b14_evidence", "factor coverage:8 distinct n ic:7 agreement:6 reasons", "bars",
    LONG + """, e0 as (select *, ntile(4) over (partition by factor order by date, symbol) as seg from long), eb as (select factor, count(value) / count(*)::double as coverage, count(distinct value) as "distinct", stddev_samp(value) as std from e0 group by 1),
ev as (select * from e0 where value is not null and label is not null),
ef as (select factor, count(*) as n, corr(a, b) as ic from (select factor, rank() over (partition by factor order by value) + (count(*) over (partition by factor, value) - 1) / 2.0e0 as a, rank() over (partition by factor order by label) + (count(*) over (partition by factor, label) - 1) / 2.0e0 as b from ev) group by 1),
es as (select factor, seg, corr(a, b) as c from (select factor, seg, rank() over (partition by factor, seg order by value) + (count(*) over (partition by factor, seg, value) - 1) / 2.0e0 as a, rank() over (partition by factor, seg order by label) + (count(*) over (partition by factor, seg, label) - 1) / 2.0e0 as b from ev) group by 1, 2),
ea as (select es.factor, avg(cast(sign(c) = sign(ic) as double)) as agreement from es join ef using (factor) group by 1)""",
    """select factor, coverage, "distinct", n, ic, agreement, concat_ws(',', case when coverage < 0.5 then 'coverage' end, case when std <= 1e-12 then 'constant' end, case when abs(ic) < 0.01 then 'weak' end, case when agreement < 0.75 then 'unstable' end) as reasons from eb join ef using (factor) join ea using (factor)""")
def _(spark, d):
    return X.evidence(written(scores_long(spark, d)), 4, 5)


@query("b17_ic_backtest", "factor hold days ic_mean:8 recent:8", "bars",
    LONG + """, h as (select date, factor, u.hold, value, u.y from long, lateral (values ('1', label), ('5', fwd_5)) u(hold, y) where factor in ('mom20', 'vol20') and value is not null and u.y is not null),
k as (select date, factor, hold, rank() over (partition by date, factor, hold order by value) + (count(*) over (partition by date, factor, hold, value) - 1) / 2.0e0 as a, rank() over (partition by date, factor, hold order by y) + (count(*) over (partition by date, factor, hold, y) - 1) / 2.0e0 as b from h),
c as (select date, factor, hold, corr(a, b) as ic, row_number() over (partition by factor, hold order by date desc) as r from k group by 1, 2, 3 having count(*) >= 5 and stddev_pop(a) >= 1e-12 and stddev_pop(b) >= 1e-12)""",
    "select factor, hold, count(*) as days, avg(ic) as ic_mean, avg(ic) filter (r <= 20) as recent from c group by 1, 2")
def _(spark, d):
    b = P.bars(spark, d)
    x = W.factor_scores(b).select("date", "symbol", "mom20", "vol20").join(W.forward_returns(b, (1, 5)).select("date", "symbol", F.col("fwd_1").alias("1"), F.col("fwd_5").alias("5")), ["date", "symbol"])
    x = xsec.melt(xsec.melt(x, ["date", "symbol", "1", "5"], ["mom20", "vol20"]), ["date", "symbol", "factor", "value"], ["1", "5"], "hold", "label")
    c = ic.rank_ic(x, ["date", "factor", "hold"], least=LEAST).where("ic is not null")
    c = c.withColumn("r", F.row_number().over(W.Window.partitionBy("factor", "hold").orderBy(F.desc("date"))))
    return c.groupBy("factor", "hold").agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic_mean"), F.avg(F.when(F.col("r") <= 20, F.col("ic"))).alias("recent"))


@query("b21_candidate_batch", "expr months ic_mean:7", "bars",
    FWD + """, ex as (select b.date, b.symbol, fwd_1, u.expr, u.v from bars b join fwd using (symbol, date), lateral (values ('turnover*change', turnover * change_pct), ('range', (high - low) / close), ('neg_change', -change_pct)) u(expr, v) where fwd_1 is not null and u.v is not null),
k as (select date, expr, rank() over (partition by date, expr order by v) + (count(*) over (partition by date, expr, v) - 1) / 2.0e0 as a, rank() over (partition by date, expr order by fwd_1) + (count(*) over (partition by date, expr, fwd_1) - 1) / 2.0e0 as b from ex),
c as (select date, expr, corr(a, b) as ic from k group by 1, 2 having count(*) >= 5 and stddev_pop(a) >= 1e-12 and stddev_pop(b) >= 1e-12)""",
    "select expr, count(*) as months, avg(ic) as ic_mean from c group by 1")
def _(spark, d):
    b = P.bars(spark, d)
    x = b.join(W.forward_returns(b, (1,)), ["symbol", "date"]).select("date", "symbol", F.col("fwd_1").alias("label"), (F.col("turnover") * F.col("change_pct")).alias("turnover*change"), ((F.col("high") - F.col("low")) / F.col("close")).alias("range"), (-F.col("change_pct")).alias("neg_change"))
    long = xsec.melt(x, ["date", "symbol", "label"], ["turnover*change", "range", "neg_change"], "expr")
    return ic.rank_ic(long, ["date", "expr"], least=LEAST).where("ic is not null").groupBy("expr").agg(F.count(F.lit(1)).alias("months"), F.avg("ic").alias("ic_mean"))


@query("b24_pool_against_universe", "date:d ic_all:7 ic_pool:7 overlap:6", "bars",
    FWD + """, x as (select b.date, b.symbol, turnover as v, fwd_1 as y, right(b.symbol, 1) < '5' as p from bars b join fwd using (symbol, date) where fwd_1 is not null),
ra as (select date, rank() over (partition by date order by v) + (count(*) over (partition by date, v) - 1) / 2.0e0 as a, rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0e0 as b from x),
rp as (select date, rank() over (partition by date order by v) + (count(*) over (partition by date, v) - 1) / 2.0e0 as a, rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0e0 as b from x where p),
ca as (select date, case when count(*) >= 5 and stddev_pop(a) >= 1e-12 and stddev_pop(b) >= 1e-12 then corr(a, b) end as ic_all from ra group by 1), cp as (select date, case when count(*) >= 5 and stddev_pop(a) >= 1e-12 and stddev_pop(b) >= 1e-12 then corr(a, b) end as ic_pool from rp group by 1),
tt as (select *, row_number() over (partition by date order by v desc, symbol) as r, row_number() over (partition by date, p order by v desc, symbol) as q from x), tp as (select date, avg(cast(r <= 10 as double)) as overlap from tt where p and q <= 10 group by 1)""",
    "select ca.date, ic_all, ic_pool, overlap from ca left join cp on cp.date = ca.date left join tp on tp.date = ca.date")
def _(spark, d):
    b = P.bars(spark, d)
    return X.pool_against_universe(b.join(W.forward_returns(b, (1,)), ["symbol", "date"]), F.expr("right(symbol, 1) < '5'"), "turnover", "fwd_1")


@query("b27_sign_schemes", "scheme days ic_mean:7", "bars",
    LONG + """, sz as (select date, symbol, factor, label, case when stddev_samp(value) over w > 1e-12 then (value - avg(value) over w) / stddev_samp(value) over w else 0 end as z from long where value is not null window w as (partition by date, factor)),
sg(scheme, factor, s) as (values ('plus', 'mom20', 1.0e0), ('plus', 'vol20', 1.0e0), ('plus', 'f_liquidity', 1.0e0), ('minus', 'mom20', -1.0e0), ('minus', 'vol20', -1.0e0), ('minus', 'f_liquidity', 1.0e0)),
sch as (select scheme, date, symbol, any_value(label) as label, round(sum(s * z), 9) as v from sz join sg using (factor) where label is not null group by 1, 2, 3),
k as (select scheme, date, rank() over (partition by scheme, date order by v) + (count(*) over (partition by scheme, date, v) - 1) / 2.0e0 as a, rank() over (partition by scheme, date order by label) + (count(*) over (partition by scheme, date, label) - 1) / 2.0e0 as b from sch),
c as (select scheme, date, corr(a, b) as ic from k group by 1, 2 having count(*) >= 5 and stddev_pop(a) >= 1e-12 and stddev_pop(b) >= 1e-12)""",
    "select scheme, count(*) as days, avg(ic) as ic_mean from c group by 1")
def _(spark, d):
    from tessera.functions.scalar import cs_zscore

    signs = spark.createDataFrame([("plus", "mom20", 1.0), ("plus", "vol20", 1.0), ("plus", "f_liquidity", 1.0), ("minus", "mom20", -1.0), ("minus", "vol20", -1.0), ("minus", "f_liquidity", 1.0)], "scheme string, factor string, s double")
    z = scores_long(spark, d).where("value is not null").withColumn("z", cs_zscore("value", "date", "factor"))
    x = z.where("label is not null").join(F.broadcast(signs), "factor").groupBy("scheme", "date", "symbol").agg(F.first("label").alias("label"), F.round(F.sum(F.col("s") * F.col("z")), 9).alias("value"))
    return ic.rank_ic(x, ["scheme", "date"], least=LEAST).where("ic is not null").groupBy("scheme").agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic_mean"))


@query("b28_direction_consistency", "window_id factors direction", "bars", IC + ", m as (select cast(year(date) as integer) as window_id, factor, avg(ic) as m from ic where ic is not null group by 1, 2), s as (select *, sign(m) = case factor when 'mom20' then -1 when 'vol20' then -1 else 1 end as same from m)",
    "select window_id, count(*) as factors, case when bool_and(same) then 'in_env' when bool_and(not same) then 'reverse' else 'mixed' end as direction from s group by 1")
def _(spark, d):
    return X.direction_consistency(daily_ics(spark, d), F.year("date"), {"mom20": -1, "vol20": -1, "f_liquidity": 1})


@query("b30_regime_routes", "regime factor days ic_mean:7", "bars", IC + """, mk as (select date, avg(change_pct) / 2000 as ret from bars where change_pct is not null group by date), rg as (select date, count(ret) over w as n, exp(sum(ln(1 + ret)) over w) - 1 as trend, stddev_samp(ret) over w * sqrt(252) as vol from mk window w as (order by date rows between 19 preceding and current row)),
re as (select date, case when n < 20 then 'unknown' when vol > 0.3 then 'high_vol' when trend > 0.05 then 'bull' when trend < -0.05 then 'bear' else 'sideways' end as regime from rg)""", "select regime, factor, count(*) as days, avg(ic) as ic_mean from ic join re using (date) where ic is not null group by 1, 2")
def _(spark, d):
    from tessera.plans.statistics import market

    x = daily_ics(spark, d).where("ic is not null").join(T.market_regime(market(spark, d)).select("date", "regime"), "date")
    return x.groupBy("regime", "factor").agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic_mean"))


@query("b54_evidence_gates", "factor status overall", "bars", SM + ", gg as (select factor, case when days < 20 then 1 when ic_mean >= 0 and win_rate >= 0.5 then 0 else 2 end as s from sm)", "select factor, ['PASS', 'INSUFFICIENT_DATA', 'FAIL'][s + 1] as status, ['PASS', 'INSUFFICIENT_DATA', 'FAIL'][max(s) over () + 1] as overall from gg")
def _(spark, d):
    return X.evidence_gate(ic.ic_summary(daily_ics(spark, d), ["factor"]))


DRIFT = IC + """, dk as (select *, row_number() over (partition by factor order by date desc) as k from ic where ic is not null), dm as (select factor, abs(avg(ic) filter (k <= 20) - avg(ic)) as drift from dk where k <= 121 group by factor)"""


@query("b70_isolated_weights", "factor weight:8 isolated", "bars", DRIFT + ", w(factor, weight) as (values ('mom20', 0.5e0), ('vol20', 0.2e0), ('f_liquidity', 0.3e0)), r as (select factor, coalesce(drift > 0.02, false) as isolated, case when coalesce(drift > 0.02, false) then 0 else weight end as raw from w left join dm using (factor))",
    "select factor, case when sum(raw) over () > 0 then raw / sum(raw) over () else 0 end as weight, isolated from r")
def _(spark, d):
    w = spark.createDataFrame([(f, abs(v)) for f, v in WEIGHTS], "factor string, weight double")
    return X.isolate(w, ic.factor_drift(daily_ics(spark, d), ["factor"], drift=0.02))


@query("b90_flip_rules", "factor old new changed", "bars", DRIFT, "select factor, drift > 0.02 as old, drift > 0.05 as new, (drift > 0.02) != (drift > 0.05) as changed from dm")
def _(spark, d):
    x = ic.factor_drift(daily_ics(spark, d), ["factor"])
    return x.select("factor", (F.col("drift") > 0.02).alias("old"), (F.col("drift") > 0.05).alias("new"), ((F.col("drift") > 0.02) != (F.col("drift") > 0.05)).alias("changed"))


@query("f21_routed_weights", "regime factor weight:8", "", "m(regime, factor, k) as (values ('bull', 'mom20', 1.5e0), ('bull', 'vol20', 0.5e0), ('bull', 'f_liquidity', 1.0e0), ('bear', 'mom20', 0.2e0), ('bear', 'vol20', 2.0e0), ('bear', 'f_liquidity', 1.0e0)), w(factor, weight) as (values ('mom20', 0.5e0), ('vol20', 0.2e0), ('f_liquidity', 0.3e0)), r as (select regime, factor, greatest(weight * k, 0) as raw from m join w using (factor))",
    "select regime, factor, raw / sum(raw) over (partition by regime) as weight from r")
def _(spark, d):
    m = spark.createDataFrame([("bull", "mom20", 1.5), ("bull", "vol20", 0.5), ("bull", "f_liquidity", 1.0), ("bear", "mom20", 0.2), ("bear", "vol20", 2.0), ("bear", "f_liquidity", 1.0)], "regime string, factor string, multiplier double")
    # only factors that have ICs in the data are routed
    seen = daily_ics(spark, d).select("factor").distinct()
    w = spark.createDataFrame([(f, abs(v)) for f, v in WEIGHTS], "factor string, weight double").join(seen, "factor", "left_semi")
    return X.routed_weights(w, m)


@query("b73_temporal_split", "date:d part", "bars", "", "select date, case when row_number() over (order by date desc) <= 12 then 'validation' when row_number() over (order by date desc) <= 15 then 'purge' else 'train' end as part from (select distinct date from bars)")
def _(spark, d):
    return X.temporal_split(P.bars(spark, d).select("date").distinct(), "date", 12, 3)


@query("b84_promotion", "factor date:d ok streak promoted", "bars",
    IC + """, w as (select factor, date, count(ic) over w >= 20 as f, avg(ic) over w as m, avg(cast(ic > 0 as double)) over w as win from ic where ic is not null window w as (partition by factor order by date rows between 19 preceding and current row)),
o as (select *, f and m >= 0 and win >= 0.5 as ok from w), gg as (select *, sum(case when ok then 0 else 1 end) over (partition by factor order by date rows unbounded preceding) as g from o)""",
    "select factor, date, ok, cast(sum(case when ok then 1 else 0 end) over (partition by factor, g order by date rows unbounded preceding) as bigint) as streak, sum(case when ok then 1 else 0 end) over (partition by factor, g order by date rows unbounded preceding) >= 3 as promoted from gg")
def _(spark, d):
    return X.promotion(daily_ics(spark, d))


@query("b81_feature_selection", "factor score:6 kept", "bars", LONG + ", p as (select date, factor, avg(value * label) as p from long where value is not null and label is not null group by 1, 2), l as (select * from p qualify row_number() over (partition by factor order by date desc) <= 20), s as (select factor, avg(p) as score from l group by 1)",
    "select factor, score, abs(score) >= 1 or row_number() over (order by abs(score) desc, factor) <= 1 as kept from s")
def _(spark, d):
    return X.feature_selection(scores_long(spark, d), 20, 1.0)


@query("b67_version_comparison", "windows mean_change:6 changed names", "bars",
    "a as (select date, symbol, row_number() over (partition by date order by turnover desc, symbol) as r, row_number() over (partition by date order by amount desc, symbol) as q, change_pct from bars), o as (select date, avg(change_pct) as v, list(symbol) as p from a where r <= 5 group by 1), n as (select date, avg(change_pct) as v, list(symbol) as p from a where q <= 5 group by 1), j as (select o.v as ov, n.v as nv, 10 - 2 * len(list_intersect(o.p, n.p)) as diff from o join n on n.date = o.date)",
    "select count(*) as windows, avg(nv - ov) as mean_change, count(*) filter (diff > 0) as changed, cast(sum(diff) as bigint) as names from j")
def _(spark, d):
    b = P.bars(spark, d)
    pick = lambda c: R.top_n(b, c, 5, "date").groupBy("date").agg(F.avg("change_pct").alias("v"), F.collect_list("symbol").alias("picks"))
    return X.compare_versions(pick("turnover"), pick("amount"), "date", "v")


@query("b78_exposure_penalty", "date:d hhi:8 penalty:8", "bars", "f as (select left(symbol, 5) as factor, date, sum(turnover) as t from bars group by 1, 2), w as (select factor, date, t / sum(t) over (partition by date) as weight from f)", "select date, sum(weight * weight) as hhi, sum(greatest(abs(weight) - 0.12, 0)) as penalty from w group by date")
def _(spark, d):
    x = P.bars(spark, d).groupBy(F.substring("symbol", 1, 5).alias("factor"), "date").agg(F.sum("turnover").alias("t"))
    return X.exposure_penalty(x.select("factor", "date", (F.col("t") / F.sum("t").over(W.Window.partitionBy("date"))).alias("weight")), 0.12)


@query("b91_drift_distribution", "factor p50:8 p95:8 most:8", "bars", "f as (select left(symbol, 5) as factor, date, sum(turnover) as t from bars group by 1, 2), w as (select factor, date, t / sum(t) over (partition by date) as weight from f), g as (select factor, abs(weight - lag(weight) over (partition by factor order by date)) as g from w)", "select factor, quantile_cont(g, 0.5) as p50, quantile_cont(g, 0.95) as p95, max(g) as most from g group by 1")
def _(spark, d):
    x = P.bars(spark, d).groupBy(F.substring("symbol", 1, 5).alias("factor"), "date").agg(F.sum("turnover").alias("t")).withColumn("weight", F.col("t") / F.sum("t").over(W.Window.partitionBy("date")))
    g = x.withColumn("g", F.abs(F.col("weight") - F.lag("weight").over(W.Window.partitionBy("factor").orderBy("date"))))
    return g.groupBy("factor").agg(F.percentile("g", F.lit(0.5)).alias("p50"), F.percentile("g", F.lit(0.95)).alias("p95"), F.max("g").alias("most"))


@query("b86_composite_forward_ic", "date:d n ic:7", "bars fin dim",
    COMPOSITE + ",\n" + FWD + """, x as (select cs.date, round(score, 9) as v, fwd_5 as y from cs join fwd using (symbol, date) where score is not null and fwd_5 is not null),
k as (select date, rank() over (partition by date order by v) + (count(*) over (partition by date, v) - 1) / 2.0e0 as a, rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0e0 as b from x)""",
    "select date, count(*) as n, corr(a, b) as ic from k group by date having count(*) >= 5 and stddev_pop(a) >= 1e-12 and stddev_pop(b) >= 1e-12")
def _(spark, d):
    x = composite_panel(spark, d).join(W.forward_returns(P.bars(spark, d), (5,)), ["symbol", "date"])
    return ic.rank_ic(x.select("date", F.round("score", 9).alias("value"), F.col("fwd_5").alias("label")), ["date"], least=LEAST).where("ic is not null").drop("status")


@query("b96_eras", "era metric:6 n", "bars", "", "select case when year(date) < 1998 then 'early' when year(date) < 2000 then 'middle' else 'late' end as era, avg(change_pct) as metric, count(*) as n from bars where change_pct is not null group by 1")
def _(spark, d):
    y = F.year("date")
    return P.bars(spark, d).where("change_pct is not null").groupBy(F.when(y < 1998, F.lit("early")).when(y < 2000, F.lit("middle")).otherwise(F.lit("late")).alias("era")).agg(F.avg("change_pct").alias("metric"), F.count(F.lit(1)).alias("n"))


@query("b97_definition_matrix", "arm windows mean:6 median:6 positive difference:6", "bars",
    "l as (select date, symbol, change_pct, u.arm, u.s from bars, lateral (values ('turnover', turnover), ('amount', amount), ('low', -low)) u(arm, s) where change_pct is not null), t as (select arm, date, avg(change_pct) as r from (select *, row_number() over (partition by arm, date order by s desc, symbol) as k from l) where k <= 10 group by 1, 2), m as (select arm, count(*) as windows, avg(r) as mean, median(r) as median, count(*) filter (r > 0) as positive from t group by arm)",
    "select arm, windows, mean, median, positive, mean - (select mean from m where arm = 'turnover') as difference from m")
def _(spark, d):
    long = P.bars(spark, d).where("change_pct is not null").withColumn("neg", -F.col("low")).select("date", "symbol", "change_pct", "turnover", "amount", F.col("neg").alias("low")).unpivot(["date", "symbol", "change_pct"], ["turnover", "amount", "low"], "arm", "s")
    t = R.top_n(long, "s", 10, "arm", "date").groupBy("arm", "date").agg(F.avg("change_pct").alias("r"))
    m = t.groupBy("arm").agg(F.count(F.lit(1)).alias("windows"), F.avg("r").alias("mean"), F.median("r").alias("median"), F.count_if(F.col("r") > 0).alias("positive"))
    base = m.where("arm = 'turnover'").select(F.col("mean").alias("base"))
    return m.crossJoin(F.broadcast(base)).withColumn("difference", F.col("mean") - F.col("base"))


@query("f09_percent_or_ratio", "symbol date:d change_pct:8", "bars", "q as (select quantile_cont(abs(change_pct), 0.999) > 0.5 as p from bars)", "select symbol, date, case when p then change_pct / 100 else change_pct end as change_pct from bars, q")
def _(spark, d):
    return X.percent_or_ratio(P.bars(spark, d), "change_pct")


# the stores: what is written to the shared folder is read again


@query("s01_merged_schemas", "symbol date:d volume patch:6", "ebars", "", "select symbol, date, volume, case when date >= date '2024-01-16' then amount / 7 end as patch from ebars")
def _(spark, d):
    at, b = shared_folder(spark), P.events_bars(spark, d)
    b.where("date < date'2024-01-16'").select("symbol", "date", "volume").write.parquet(f"{at}/old")
    b.where("date >= date'2024-01-16'").select("symbol", "date", "volume", (F.col("amount") / 7).alias("patch")).write.parquet(f"{at}/new")
    return stores.read_merged(spark, [f"{at}/old", f"{at}/new"], {"symbol": "string", "date": "date", "volume": "long", "patch": "double"})


@query("s09_versioned", "version n", "ebars", "", "select 'a' as version, count(*) as n from ebars union all select 'b', count(*) from ebars where volume > 2")
def _(spark, d):
    at, b = shared_folder(spark), P.events_bars(spark, d)
    stores.write_version(b, at, "a")
    stores.write_version(b.where("volume > 2"), at, "b")
    both = [stores.read_version(spark, at, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("version"), "n") for t in ("a", "b")]
    return both[0].unionByName(both[1])


@query("s10_monotone_append", "date:d n", "ebars", "", "select date, count(*) as n from ebars where date <= date '2024-01-10' or date > date '2024-01-12' group by date")
def _(spark, d):
    at, b = shared_folder(spark), P.events_bars(spark, d)
    stores.append_days(b.where("date <= date'2024-01-10'"), at)
    stores.append_days(b.where("date > date'2024-01-12'"), at)
    stores.append_days(b.where("date <= date'2024-01-12'"), at)  # all before the table's last day
    return spark.read.parquet(at).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("s13_insert_absent", "symbol n", "ebars", "", "select symbol, count(*) as n from ebars group by symbol")
def _(spark, d):
    at, b = shared_folder(spark), P.events_bars(spark, d)
    stores.append_absent(b.where("volume > 2"), at, ["symbol", "date"])
    stores.append_absent(b, at, ["symbol", "date"])
    return spark.read.parquet(at).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("s14_replaced_day", "date:d volume", "ebars", "", "select date, cast(sum(volume * case when date = date '2024-01-05' then 3 else 1 end) as bigint) as volume from ebars group by date")
def _(spark, d):
    at, b = shared_folder(spark), P.events_bars(spark, d)
    stores.replace_days(b, at)
    stores.replace_days(b.where("date = date'2024-01-05'").withColumn("volume", F.col("volume") * 3), at)
    return spark.read.parquet(at).groupBy("date").agg(F.sum("volume").alias("volume"))


@query("s17_materialised_views", "view rows", "bars", "", "select 'breadth' as view, count(distinct date) as rows from bars where change_pct is not null union all select 'scores', count(*) from bars")
def _(spark, d):
    b = P.bars(spark, d)
    return stores.write_views({"scores": W.factor_scores(b), "breadth": R.market_breadth(b)}, shared_folder(spark))


@query("s18_ledger", "kind n", "", "", "select 'bad' as kind, count(*) as n from events where user_id % 50 = 0 union all select 'good', count(*) from events where user_id % 50 != 0")
def _(spark, d):
    at = shared_folder(spark)
    e = P.read(spark, d, "events")
    line = F.when(F.col("user_id") % 50 == 0, F.concat(F.lit("{broken "), F.col("event_id"))).otherwise(F.to_json(F.struct(F.col("event_id").alias("seq"), "event_type")))
    e.select(line.alias("value")).write.text(at)
    good, bad = stores.read_ledger(spark, at, "seq long, event_type string")
    return good.agg(F.count("seq").alias("n")).select(F.lit("good").alias("kind"), "n").unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad").alias("kind"), "n"))


HYPOTHESES = [
    X.Hypothesis("level", "close", ("close",)), X.Hypothesis("against", "-close", ("close",)), X.Hypothesis("spread", "(high - low) / close", ("high", "low", "close")),
    X.Hypothesis("late", "fwd_1", ("fwd_1",)), X.Hypothesis("unknown", "roe", ("roe",)), X.Hypothesis("busy", "turnover", ("turnover",)),
]


@query("v02_evaluated_hypotheses", "factor stage status", "bars",
    """long as (select date, symbol, u.factor, u.value, change_pct as label from bars, lateral (values ('level', close), ('against', -close), ('spread', (high - low) / close), ('busy', cast(turnover as double))) u(factor, value)),
e0 as (select *, ntile(4) over (partition by factor order by date, symbol) as seg from long), eb as (select factor, count(value) / count(*)::double as coverage, stddev_samp(value) as std from e0 group by 1),
ev as (select * from e0 where value is not null and label is not null),
ef as (select factor, corr(a, b) as ic from (select factor, rank() over (partition by factor order by value) + (count(*) over (partition by factor, value) - 1) / 2.0e0 as a, rank() over (partition by factor order by label) + (count(*) over (partition by factor, label) - 1) / 2.0e0 as b from ev) group by 1),
es as (select factor, seg, corr(a, b) as c from (select factor, seg, rank() over (partition by factor, seg order by value) + (count(*) over (partition by factor, seg, value) - 1) / 2.0e0 as a, rank() over (partition by factor, seg order by label) + (count(*) over (partition by factor, seg, label) - 1) / 2.0e0 as b from ev) group by 1, 2),
ea as (select es.factor, avg(cast(sign(c) = sign(ic) as double)) as agreement from es join ef using (factor) group by 1),
ok as (select factor from eb join ef using (factor) join ea using (factor) where coverage >= 0.5 and std > 1e-12 and ic >= 0.01 and agreement >= 0.75),
md as (select factor, date, count(*) as n, median(value) as m from ev group by 1, 2),
dy as (select factor, date, avg(label) filter (value > m) - avg(label) filter (value <= m) as d from ev join md using (factor, date) join ok using (factor) where n >= 5 group by 1, 2),
ps as (select factor, avg(d) > 0 as passed from dy group by 1)""",
    """select factor, 'return_evaluated' as stage, case when coalesce(passed, false) then 'verified' else 'falsified' end as status from ok left join ps using (factor)
union all select factor, 'evidence_rejected', 'rejected' from eb where factor not in (select factor from ok)
union all select * from (values ('late', 'lint_rejected', 'rejected'), ('unknown', 'lint_rejected', 'rejected'))""")
def _(spark, d):
    b = P.bars(spark, d)
    panel = W.with_forward(b, (1,)).withColumn("label", F.col("change_pct"))
    return X.validate_batch(panel, HYPOTHESES, X.daily_evaluator(X.upper_half))
