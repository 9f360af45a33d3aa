"""Queries over weights, portfolios, costs, performance and order rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import portfolio as B
from tessera.operators import relational as R
from tessera.operators import windows as W
from tessera.plans.registry import query
from tessera.plans.relational import ADV
from tessera.plans.windows import FWD
from tessera.sources import panels as P

TOP = """tp as (select date, symbol, turnover from bars qualify row_number() over (partition by date order by turnover desc, symbol) <= 20),
wt as (select date, symbol, turnover / sum(turnover) over (partition by date) as weight from tp)"""


def top_weights(spark, d):
    return B.normalize_weights(R.top_n(P.bars(spark, d), "turnover", 20, "date").select("date", "symbol", F.col("turnover").alias("weight")), "date").select("date", "symbol", "weight")


@query("b08_rank_linear_weights", "date:d symbol weight:8", "bars",
    "tp as (select date, symbol, row_number() over (partition by date order by turnover desc, symbol) - 1 as k, count(*) over (partition by date) as n from bars qualify row_number() over (partition by date order by turnover desc, symbol) <= 20), w0 as (select *, 0.0e0 as z, (1.21e0 - (1.21e0 - 0.6e0) * k / greatest(count(*) over (partition by date) - 1, 1)) / count(*) over (partition by date) as weight, count(*) over (partition by date) as m from tp),\n"
    + ",\n".join(f"v{i} as (select date, symbol, m, least(greatest(weight / sum(weight) over (partition by date), 0.6e0 / m), 1.21e0 / m) as weight from w{i}), w{i + 1} as (select * from v{i})" for i in range(6)),
    "select date, symbol, weight / sum(weight) over (partition by date) as weight from w6")
def _(spark, d):
    return B.rank_linear_weights(R.top_n(P.bars(spark, d), "turnover", 20, "date").select("date", "symbol", "turnover"), "turnover", "date")


@query("b09_normalized_weights", "date:d symbol weight:8 error", "bars",
    "x as (select date, symbol, change_pct as w, max(case when change_pct is null or change_pct <= 0 then 1 else 0 end) over (partition by date) as bad from bars where change_pct > 0 or (month(date) = 3))",
    "select date, symbol, case when bad = 0 then w / sum(w) over (partition by date) end as weight, case when bad = 1 then 'invalid_weight' end as error from x")
def _(spark, d):
    x = P.bars(spark, d).where("change_pct > 0 or month(date) = 3").select("date", "symbol", F.col("change_pct").alias("weight"))
    return B.normalize_weights(x, "date")


@query("b80_weights_from_targets", "date:d symbol weight:8", "bars",
    "x as (select date, symbol, case when volume % 50 != 0 then turnover end as w from bars), y as (select *, max(case when w is null or w <= 0 then 1 else 0 end) over (partition by date) as lack from x)",
    "select date, symbol, case when lack = 1 then 1.0e0 / count(*) over (partition by date) else w / sum(w) over (partition by date) end as weight from y")
def _(spark, d):
    x = P.bars(spark, d).select("date", "symbol", F.when(F.col("volume") % 50 != 0, F.col("turnover")).alias("weight"))
    return B.weights_from_targets(x, "date")


@query("b36_combined_legs", "date:d symbol weight:8 legs", "bars",
    """l as (select 'a' as leg, 0.7e0 as lw, date, symbol, turnover as w from bars where volume % 2 = 0 union all select 'b', 0.3e0, date, symbol, amount from bars where volume % 3 = 0),
n as (select *, lw * w / sum(w) over (partition by leg, date) as v from l)""", "select date, symbol, sum(v) as weight, count(*) as legs from n group by 1, 2")
def _(spark, d):
    b = P.bars(spark, d)
    a = b.where("volume % 2 = 0").select(F.lit("a").alias("leg"), F.lit(0.7).alias("leg_weight"), "date", "symbol", F.col("turnover").alias("weight"))
    c = b.where("volume % 3 = 0").select(F.lit("b").alias("leg"), F.lit(0.3).alias("leg_weight"), "date", "symbol", F.col("amount").alias("weight"))
    return B.combine_legs(a.unionByName(c))


PORT = FWD + ",\n" + TOP + """, cal as (select date, row_number() over (order by date) as i from (select distinct date from wt)), wi as (select w.*, i from wt w join cal using (date)),
ch as (select coalesce(a.i, b.i + 1) as i, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) / 2 as turnover from wi a full outer join wi b on a.symbol = b.symbol and a.i = b.i + 1 group by 1),
gr as (select w.date, w.i, sum(weight * coalesce(fwd_1, 0)) as gross from wi w join fwd f on f.date = w.date and f.symbol = w.symbol group by 1, 2),
pf as (select g.date, gross, turnover, turnover * 10 / 1e4 as cost, gross - turnover * 10 / 1e4 as net from gr g join ch on ch.i = g.i),
port as (select *, exp(sum(ln(greatest(1 + net, 1e-12))) over (order by date rows unbounded preceding)) as equity from pf)"""


def portfolio(spark, d):
    b = P.bars(spark, d)
    return B.portfolio_returns(top_weights(spark, d), W.forward_returns(b, (1,)).select("date", "symbol", F.col("fwd_1").alias("ret")))


@query("b37_portfolio_returns", "date:d gross:8 turnover:8 cost:9 net:8 log_equity:7", "bars", PORT, "select *, ln(equity) as log_equity from port")
def _(spark, d):
    return portfolio(spark, d).withColumn("log_equity", F.log("equity"))


@query("b38_turnover_definitions", "date:d name_turnover:8 weight_turnover:8 status", "bars",
    TOP + """, cal as (select date, row_number() over (order by date) as i from (select distinct date from wt)), wi as (select w.*, i from wt w join cal using (date)),
j as (select coalesce(a.i, b.i + 1) as i, a.weight as w, b.weight as v from wi a full outer join wi b on a.symbol = b.symbol and a.i = b.i + 1),
g as (select i, greatest(count(*) filter (v is null), count(*) filter (w is null)) / greatest(count(w), count(v))::double as nt, (sum(abs(coalesce(w, 0) - coalesce(v, 0))) + abs(sum(coalesce(w, 0)) - sum(coalesce(v, 0)))) / 2 as wtn, count(v) as had from j group by i)""",
    "select date, case when had > 0 then nt end as name_turnover, case when had > 0 then wtn end as weight_turnover, case when had > 0 then 'ok' else 'missing' end as status from g join cal using (i)")
def _(spark, d):
    return B.turnover_definitions(top_weights(spark, d))


@query("b39_fill_costs", "symbol side n errors price_cost:3 explicit_cost:4 total_cost:3", "fills",
    "x as (select symbol, side, tax, (fill_price - decision_price) * qty * case side when 'buy' then 1 else -1 end as pc, greatest(qty * fill_price * 0.00025e0, 5) + case side when 'sell' then qty * fill_price * 0.0005e0 else 0 end + qty * fill_price * 0.00001e0 as ec from fills)",
    "select symbol, side, count(*) as n, cast(sum(case when tax > 0.07 then 1 else 0 end) as bigint) as errors, sum(pc) as price_cost, sum(ec) as explicit_cost, sum(case when not tax > 0.07 then pc + ec end) as total_cost from x group by 1, 2")
def _(spark, d):
    x = B.fill_costs(P.fills(spark, d))
    return x.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("errors")).alias("errors"), F.sum("price_cost").alias("price_cost"), F.sum("explicit_cost").alias("explicit_cost"), F.sum("total_cost").alias("total_cost"))


@query("b40_dividends", "symbol ex_date:d bonus_shares cash:4 tax:5", "ebars", "p as (select symbol, min(date) as buy, 1000 + 7 * count(*) as q from ebars group by symbol)",
    "select p.symbol, e.date as ex_date, cast(floor(q / 10.0e0 * 1.5e0) as bigint) as bonus_shares, q / 10.0e0 * 0.73e0 as cash, q / 10.0e0 * 0.73e0 * case when e.date - buy > 365 then 0 when e.date - buy > 30 then 0.1e0 else 0.2e0 end as tax from p join ebars e on e.symbol = p.symbol where e.volume >= 5")
def _(spark, d):
    b = P.events_bars(spark, d)
    p = b.groupBy("symbol").agg(F.min("date").alias("buy_date"), (1000 + 7 * F.count(F.lit(1))).alias("qty"))
    e = b.where("volume >= 5").select("symbol", F.col("date").alias("ex_date"), F.lit(1.5).alias("bonus_per10"), F.lit(0.73).alias("cash_per10"))
    return B.dividends(p.join(e, "symbol"))


ORDERS = """od as (select l_orderkey as order_id, l_linenumber as k, lpad(cast(l_suppkey as varchar), 6, '0') as symbol, case when l_returnflag = 'R' then 'sell' else 'buy' end as side, cast(l_quantity * 50 as bigint) as qty, l_extendedprice / l_quantity / 100 as price,
    case when l_partkey % 4 != 0 then l_partkey * 200.0e0 end as cash, case when l_partkey % 5 != 0 then l_partkey * 1000.0e0 end as equity, case when l_partkey % 3 != 0 then cast(l_partkey % 3000 as bigint) end as sellable_qty from lineitem)"""


def orders(spark, d):
    k = F.col("l_partkey")
    return P.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("k"), P.symbol(F.col("l_suppkey")).alias("symbol"), F.when(F.col("l_returnflag") == "R", F.lit("sell")).otherwise(F.lit("buy")).alias("side"),
        (F.col("l_quantity") * 50).cast("long").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("price"), F.when(k % 4 != 0, k * 200.0).alias("cash"), F.when(k % 5 != 0, k * 1000.0).alias("equity"), F.when(k % 3 != 0, k % 3000).alias("sellable_qty"),
    )


@query("b41_order_screening", "status violations n", "", ORDERS + """, v as (select case when side = 'buy' and qty % 100 != 0 then 'lot ' else '' end || case when side = 'buy' and cash is not null and cash - qty * price < 0 then 'cash ' else '' end || case when side = 'sell' and sellable_qty is not null and qty > sellable_qty then 'sellable ' else '' end
    || case when side = 'buy' and equity is not null and qty * price > 0.3e0 * equity then 'position ' else '' end as violations, (side = 'buy' and cash is null) or (side = 'sell' and sellable_qty is null) or (side = 'buy' and equity is null) as skip from od)""",
    "select case when violations != '' then 'fail' when skip then 'skip' else 'pass' end as status, violations, count(*) as n from v group by 1, 2")
def _(spark, d):
    x = B.screen_orders(orders(spark, d))
    return x.groupBy("status", F.array_join(F.transform("violations", lambda v: F.concat(v, F.lit(" "))), "").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("b42_twap_slices", "slice qty n", "", ORDERS + ", x as (select qty, unnest([0, 1, 2, 3]) as slice from od)", "select slice, cast(sum(((qty // 100) // 4 + case when slice < (qty // 100) % 4 then 1 else 0 end) * 100 + case when slice = 3 then qty % 100 else 0 end) as bigint) as qty, count(*) as n from x group by slice")
def _(spark, d):
    return B.slice_twap(orders(spark, d)).groupBy("slice").agg(F.sum("slice_qty").alias("qty"), F.count(F.lit(1)).alias("n"))


@query("b42_vwap_slices", "order_id slice slice_qty", "", "o as (select o_orderkey as order_id, cast(floor(o_totalprice / 100) as bigint) as qty from orders), p(slice, volume) as (values (0, 30.0e0), (1, 15.0e0), (2, 20.0e0), (3, 35.0e0)), x as (select *, (qty // 100) * (volume / 100.0e0) as e from o, p), y as (select *, floor(e) as b, row_number() over (partition by order_id order by round(e - floor(e), 9) desc, slice) as r from x)",
    "select order_id, slice, cast((b + case when r <= qty // 100 - sum(b) over (partition by order_id) then 1 else 0 end) * 100 as bigint) as slice_qty from y")
def _(spark, d):
    o = P.read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.floor(F.col("o_totalprice") / 100).alias("qty"))
    return B.slice_vwap(o, spark.createDataFrame([(0, 30.0), (1, 15.0), (2, 20.0), (3, 35.0)], "slice int, volume double"))


@query("b68_split_decisions", "order_id k n participation:8 slices multi_day fillable:4", "bars fills", ADV + ", x as (select order_id, fill_id as k, qty * fill_price * 10 as notional, adv from fills join adv using (symbol))",
    "select order_id, k, count(*) as n, max(notional / adv) as participation, max(cast(least(greatest(ceil(notional / adv / 0.1e0), 1), 20) as integer)) as slices, bool_or(notional / adv > 0.1e0 * 20) as multi_day, sum(least(notional, adv * 0.1e0 * 20)) as fillable from x group by 1, 2")
def _(spark, d):
    x = P.fills(spark, d).join(R.adv_vol(P.bars(spark, d)), "symbol").select("order_id", F.col("fill_id").alias("k"), (F.col("qty") * F.col("fill_price") * 10).alias("notional"), "adv")
    return B.split_decision(x).groupBy("order_id", "k").agg(F.count(F.lit(1)).alias("n"), F.max("participation").alias("participation"), F.max("slices").alias("slices"), F.bool_or("multi_day").alias("multi_day"), F.sum("fillable").alias("fillable"))


CURVES = "cv as (select left(symbol, 5) as curve_id, date, sum(amount) as equity from bars group by 1, 2)"


def curves(spark, d):
    return P.bars(spark, d).groupBy(F.substring("symbol", 1, 5).alias("curve_id"), "date").agg(F.sum("amount").alias("equity"))


METRICS = CURVES + """, c1 as (select *, equity / lag(equity) over w - 1 as r, 1 - equity / max(equity) over (w rows unbounded preceding) as dd, row_number() over w as k, count(*) over (partition by curve_id) as n from cv window w as (partition by curve_id order by date)),
c2 as (select curve_id, count(*) as days, arg_min(equity, k) as f, arg_max(equity, k) as l, avg(r) as m, stddev_samp(r) as s, sqrt(avg(case when r is not null then least(r, 0) * least(r, 0) end)) as down, max(dd) as max_drawdown, arg_max(equity, k) filter (k <= n // 2) as mid from c1 group by curve_id),
c3 as (select curve_id, avg(g) as gm, stddev_samp(g) as gs from (select curve_id, (k - 1) * 4 // n as seg, arg_max(equity, k) / arg_min(equity, k) - 1 as g from c1 group by 1, 2) group by 1),
cm as (select curve_id, days, l / f - 1 as total, pow(l / f, 252.0e0 / (days - 1)) - 1 as cagr, m / s * sqrt(252) as sharpe, m / down * sqrt(252) as sortino, max_drawdown, (l / f - 1) / max_drawdown as recovery, (l / mid - 1) / (mid / f - 1) as efficiency, gs / abs(gm) as segment_cv from c2 join c3 using (curve_id))"""


@query("b31_curve_metrics", "curve_id days total:6 cagr:5 sharpe:6 sortino:6 max_drawdown:6 recovery:6 efficiency:5 segment_cv:5", "bars", METRICS, "select * from cm")
def _(spark, d):
    return B.curve_metrics(curves(spark, d))


@query("b33_verdicts", "curve_id metric value:5 verdict", "bars", METRICS + ", u as (select curve_id, v.metric, v.value from cm, lateral (values ('sharpe', sharpe), ('max_drawdown', max_drawdown), ('recovery', recovery)) v(metric, value))",
    "select *, case when value is null then 'INSUFFICIENT_DATA' when case metric when 'sharpe' then value >= 0.5 when 'max_drawdown' then value <= 0.8 else value >= 0.1 end then 'PASS' else 'FAIL' end as verdict from u")
def _(spark, d):
    return B.verdict(B.curve_metrics(curves(spark, d)), "curve_id", {"sharpe": (">=", 0.5), "max_drawdown": ("<=", 0.8), "recovery": (">=", 0.1)})


@query("b32_trade_metrics", "symbol trades win_rate:8 profit_factor:6 expectancy:6", "fills", "x as (select symbol, (tax - 0.04e0) * qty as pnl from fills), y as (select symbol, count(*) as trades, avg(cast(pnl > 0 as double)) as win_rate, sum(case when pnl > 0 then pnl else 0 end) as w, sum(case when pnl < 0 then -pnl else 0 end) as l, avg(pnl) as expectancy from x group by symbol)",
    "select symbol, trades, win_rate, case when l > 0 then least(w / l, 999) when w > 0 then 999 else 0 end as profit_factor, expectancy from y")
def _(spark, d):
    return B.trade_metrics(P.fills(spark, d).select("symbol", ((F.col("tax") - 0.04) * F.col("qty")).alias("pnl")), "symbol")


@query("b34_relative_report", "date:d log_portfolio:7 log_benchmark:7 excess:6", "bars", PORT + ", bm as (select date, avg(fwd_1) as b from fwd group by date), r as (select p.date, exp(sum(ln(1 + net)) over (order by p.date rows unbounded preceding)) - 1 as portfolio, exp(sum(ln(1 + coalesce(b, 0))) over (order by p.date rows unbounded preceding)) - 1 as benchmark from port p join bm on bm.date = p.date)",
    "select date, ln(1 + portfolio) as log_portfolio, ln(1 + benchmark) as log_benchmark, (1 + portfolio) / (1 + benchmark) - 1 as excess from r")
def _(spark, d):
    b = W.forward_returns(P.bars(spark, d), (1,)).groupBy("date").agg(F.avg("fwd_1").alias("b"))
    w = W.Window.orderBy("date").rowsBetween(W.Window.unboundedPreceding, 0)  # a row for each day
    x = portfolio(spark, d).join(b, "date").select("date", (F.exp(F.sum(F.log(1 + F.col("net"))).over(w)) - 1).alias("portfolio"), (F.exp(F.sum(F.log(1 + F.coalesce("b", F.lit(0.0)))).over(w)) - 1).alias("benchmark"))
    return x.withColumns({"excess": (1 + F.col("portfolio")) / (1 + F.col("benchmark")) - 1, "log_portfolio": F.log(1 + F.col("portfolio")), "log_benchmark": F.log(1 + F.col("benchmark"))})


@query("b35_exposure_audit", "days avg_names:6 max_weight:8 avg_turnover:8", "bars", PORT, "select (select count(*) from port) as days, (select count(*) from wt) / (select count(distinct date) from wt)::double as avg_names, (select max(weight) from wt) as max_weight, (select avg(turnover) from port) as avg_turnover")
def _(spark, d):
    w = top_weights(spark, d).agg((F.count(F.lit(1)) / F.countDistinct("date")).alias("avg_names"), F.max("weight").alias("max_weight"))
    return portfolio(spark, d).agg(F.count(F.lit(1)).alias("days"), F.avg("turnover").alias("avg_turnover")).crossJoin(F.broadcast(w))


@query("b22_shadow_arms", "date:d arm n jaccard:8 top_return:7 excess:7", "bars",
    FWD + """, l as (select b.date, b.symbol, fwd_1, u.arm, u.score from bars b join fwd using (symbol, date), lateral (values ('turnover', turnover), ('amount', amount), ('open', open)) u(arm, score)),
r as (select *, row_number() over (partition by date, arm order by score desc, symbol) as r, avg(fwd_1) over (partition by date, arm) as base from l where score is not null), t as (select * from r where r <= 20),
j as (select t.*, c.symbol as c from t left join (select date, symbol from t where arm = 'turnover') c on c.date = t.date and c.symbol = t.symbol)""",
    "select date, arm, count(*) as n, count(c) / (2.0e0 * count(*) - count(c)) as jaccard, avg(fwd_1) as top_return, avg(fwd_1) - any_value(base) as excess from j group by 1, 2")
def _(spark, d):
    b = P.bars(spark, d)
    return B.shadow_arms(b.join(W.forward_returns(b, (1,)), ["symbol", "date"]), ["turnover", "amount", "open"], "fwd_1")


@query("b23_benchmark", "date:d horizon benchmark:7 names", "bars", FWD + ", l as (select date, u.horizon, u.r from fwd, lateral (values ('fwd_1', fwd_1), ('fwd_5', fwd_5)) u(horizon, r))", "select date, horizon, avg(r) as benchmark, count(r) as names from l where r is not null group by 1, 2")
def _(spark, d):
    x = W.forward_returns(P.bars(spark, d), (1, 5)).unpivot(["symbol", "date"], ["fwd_1", "fwd_5"], "horizon", "r").where("r is not null")
    return x.groupBy("date", "horizon").agg(F.avg("r").alias("benchmark"), F.count("r").alias("names"))


@query("b26_trim_sensitivity", "q date:d ret:7", "bars", FWD + ", gq as (select unnest([0.0e0, 0.05e0, 0.1e0]) as q), x as (select q, b.date, fwd_1, row_number() over (partition by q, b.date order by turnover desc, symbol) as k, count(*) over (partition by q, b.date) as n from bars b join fwd using (symbol, date) cross join gq where fwd_1 is not null)",
    "select q, date, avg(fwd_1) as ret from x where k > floor(n * q + 1e-9) and k <= floor(n * q + 1e-9) + 20 group by 1, 2")
def _(spark, d):
    b = P.bars(spark, d)
    return B.trim_sensitivity(b.join(W.forward_returns(b, (1,)), ["symbol", "date"]), "turnover", "fwd_1", [0.0, 0.05, 0.1])


@query("b25_construction_matrix", "arm scheme days mean_return:7", "bars",
    FWD + """, l as (select b.date, b.symbol, fwd_1, u.arm, u.score from bars b join fwd using (symbol, date), lateral (values ('turnover', turnover), ('amount', amount)) u(arm, score) where fwd_1 is not null),
t as (select *, row_number() over (partition by date, arm order by score desc, symbol) as r from l qualify r <= 20), s as (select t.*, u.scheme, u.w from t, lateral (values ('equal', 1.0e0), ('score', score)) u(scheme, w)),
p as (select date, arm, scheme, sum(w * fwd_1) / sum(w) as ret from s group by 1, 2, 3)""",
    "select arm, scheme, count(*) as days, avg(ret) as mean_return from p group by 1, 2")
def _(spark, d):
    b = P.bars(spark, d)
    long = b.join(W.forward_returns(b, (1,)), ["symbol", "date"]).where("fwd_1 is not null").unpivot(["date", "symbol", "fwd_1"], ["turnover", "amount"], "arm", "score")
    top = R.top_n(long, "score", 20, "date", "arm").withColumn("equal", F.lit(1.0))
    s = top.withColumnRenamed("score", "score_w").select("date", "arm", "symbol", "fwd_1", "equal", F.col("score_w").alias("score")).unpivot(["date", "arm", "symbol", "fwd_1"], ["equal", "score"], "scheme", "w")
    p = s.groupBy("date", "arm", "scheme").agg((F.sum(F.col("w") * F.col("fwd_1")) / F.sum("w")).alias("ret"))
    return p.groupBy("arm", "scheme").agg(F.count(F.lit(1)).alias("days"), F.avg("ret").alias("mean_return"))


@query("b64_window_attribution", "segment days total:6", "bars", PORT + ", x as (select net, (row_number() over (order by date) - 1) // 12 as segment from port)", "select cast(segment as bigint) as segment, count(*) as days, exp(sum(ln(1 + net))) - 1 as total from x group by 1")
def _(spark, d):
    x = portfolio(spark, d).withColumn("segment", F.floor((F.row_number().over(W.Window.orderBy("date")) - 1) / 12))
    return x.groupBy("segment").agg(F.count(F.lit(1)).alias("days"), (F.exp(F.sum(F.log(1 + F.col("net")))) - 1).alias("total"))


@query("b65_curve_parity", "curve_id days gap:8 worst:8", "bars",
    CURVES + ", a as (select *, equity / lag(equity) over (partition by curve_id order by date) - 1 as r from cv), b as (select curve_id, date, e / lag(e) over (partition by curve_id order by date) - 1 as r from (select curve_id, date, equity * (1 + month(date) / 1000.0e0) as e from cv where month(date) != 7))",
    "select a.curve_id, count(*) as days, avg(a.r - b.r) as gap, max(abs(a.r - b.r)) as worst from a join b using (curve_id, date) where a.r is not null and b.r is not null group by 1")
def _(spark, d):
    c = curves(spark, d)
    r = lambda e: (F.col(e) / F.lag(e).over(W.Window.partitionBy("curve_id").orderBy("date")) - 1)
    a = c.select("curve_id", "date", r("equity").alias("ra"))
    b = c.where("month(date) != 7").withColumn("e", F.col("equity") * (1 + F.month("date") / 1000)).select("curve_id", "date", r("e").alias("rb"))
    x = a.join(b, ["curve_id", "date"]).where("ra is not null and rb is not null")
    return x.groupBy("curve_id").agg(F.count(F.lit(1)).alias("days"), F.avg(F.col("ra") - F.col("rb")).alias("gap"), F.max(F.abs(F.col("ra") - F.col("rb"))).alias("worst"))


@query("b74_curve_reward", "curve_id reward:5", "bars", CURVES + ", r as (select curve_id, equity / lag(equity) over (partition by curve_id order by date) - 1 as r from cv), s as (select curve_id, count(r) as n, avg(r) as m, stddev_samp(r) as s, sqrt(avg(case when r is not null then least(r, 0) * least(r, 0) end)) as d, quantile_cont(r, 0.05) as q from r group by 1)",
    "select curve_id, least(greatest(m / d / (1 + 10 * s) - 0.5e0 * abs(case when n >= 20 then q else 0 end), -5), 5) as reward from s")
def _(spark, d):
    from tessera.functions.scalar import clip

    x = curves(spark, d).withColumn("r", F.col("equity") / F.lag("equity").over(W.Window.partitionBy("curve_id").orderBy("date")) - 1)
    down = F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least("r", F.lit(0.0)), F.lit(2)))))
    s = x.groupBy("curve_id").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), down.alias("d"), F.percentile("r", F.lit(0.05)).alias("q"))
    return s.select("curve_id", clip(F.col("m") / F.col("d") / (1 + 10 * F.col("s")) - 0.5 * F.abs(F.when(F.col("n") >= 20, F.col("q")).otherwise(0.0)), -5, 5).alias("reward"))


@query("b75_risk_sizing", "symbol size:7 level", "bars", "s as (select symbol, stddev_samp(change_pct) / 100 as v, avg(change_pct) / 100 as m, case cast(symbol as integer) % 4 when 0 then 'bull' when 1 then 'bear' when 2 then 'high_vol' else 'other' end as regime, quantile_cont(change_pct / -100, 0.95) as c from bars group by symbol)",
    "select symbol, least(greatest(least(0.15e0 / v, 0.5e0 * m / (v * v)), 0), 1) * case regime when 'bull' then 1 when 'bear' then 0.5e0 when 'high_vol' then 0.4e0 else 0.75e0 end as size, least(cast(m > 0.1 as int) + cast(v > 0.3 as int) + cast(c > 0.05 as int) + cast(c > 0.03 as int), 3) as level from s")
def _(spark, d):
    c = F.col("change_pct")
    k = F.col("symbol").cast("int") % 4
    s = P.bars(spark, d).groupBy("symbol").agg((F.stddev_samp(c) / 100).alias("v"), (F.avg(c) / 100).alias("m"), F.percentile(c / -100, F.lit(0.95)).alias("c"))
    s = s.withColumn("regime", F.when(k == 0, F.lit("bull")).when(k == 1, F.lit("bear")).when(k == 2, F.lit("high_vol")).otherwise(F.lit("other")))
    return s.select("symbol", B.size_position(F.col("v"), F.col("m"), F.col("regime")).alias("size"), B.breaker_level(F.col("m"), F.col("v"), F.col("c"), F.col("c")).alias("level"))


@query("b77_outlier_confidence", "symbol date:d confidence:6", "bars", "x as (select symbol, date, turnover, avg(turnover) over w as m, case when count(turnover) over w >= 20 then stddev_pop(turnover) over w else 1 end as s from bars window w as (partition by symbol order by date rows between 19 preceding and current row)), y as (select *, case when s > 1e-12 then abs(turnover - m) / s else 0 end as dev from x)",
    "select symbol, date, case when dev <= 2.5 then 1 else greatest(0.1, exp(-(dev - 2.5) / 2)) end as confidence from y")
def _(spark, d):
    return P.bars(spark, d).select("symbol", "date", B.outlier_confidence("turnover").alias("confidence"))


@query("b88_basket_return", "segment names basket:7", "bars", "c as (select date, (row_number() over (order by date) - 1) // 10 as segment from (select distinct date from bars)), x as (select segment, symbol, count(*) as n, exp(sum(ln(1 + change_pct / 100))) - 1 as r from bars join c using (date) where change_pct is not null group by 1, 2)",
    "select cast(segment as bigint) as segment, count(*) as names, avg(r) as basket from x group by 1")
def _(spark, d):
    b = P.bars(spark, d).where("change_pct is not null")
    cal = P.calendar(P.bars(spark, d)).select("date", F.floor(F.col("idx") / 10).alias("segment"))
    x = b.join(F.broadcast(cal), "date").groupBy("segment", "symbol").agg((F.exp(F.sum(F.log(1 + F.col("change_pct") / 100))) - 1).alias("r"))
    return x.groupBy("segment").agg(F.count(F.lit(1)).alias("names"), F.avg("r").alias("basket"))


@query("b99_cost_rules", "rule log_total:7", "bars", PORT + ", r(rule, bps) as (values ('old', 10.0e0), ('new', 3.0e0)), x as (select rule, sum(ln(1 + gross - turnover * bps / 1e4)) as log_total from pf cross join r group by rule)", "select * from x")
def _(spark, d):
    rules = spark.createDataFrame([("old", 10.0), ("new", 3.0)], "rule string, bps double")
    x = portfolio(spark, d).crossJoin(F.broadcast(rules))
    return x.groupBy("rule").agg(F.sum(F.log(1 + F.col("gross") - F.col("turnover") * F.col("bps") / 1e4)).alias("log_total"))


@query("b100_history_universe", "symbol rows", "bars", "", "select symbol, count(*) as rows from bars where date <= date '2000-06-30' group by symbol having count(*) >= 60")
def _(spark, d):
    return P.bars(spark, d).where("date <= date'2000-06-30'").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).where("rows >= 60")
