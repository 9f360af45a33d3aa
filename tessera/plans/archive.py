"""Queries over archives, daily evidence, monthly evaluation and validation batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import archive as A
from tessera.operators import ic, quality, xsec
from tessera.operators import portfolio as B
from tessera.operators import windows as W
from tessera.plans.evaluation import COMPOSITE, FUSION, IC, LEAST, NEUTRAL, PIT, WATCH, WATCH_SCORE, WATCHED, composite_panel, neutral_panel, pit_panel, scores_long
from tessera.plans.portfolio import PORT, TOP, portfolio, top_weights
from tessera.plans.registry import query
from tessera.plans.windows import FWD
from tessera.sources import panels as P

RANK = "rank() over (partition by {k} order by {v}) + (count(*) over (partition by {k}, {v}) - 1) / 2.0e0"
OK = "count(*) >= 5 and stddev_pop(a) >= 1e-12 and stddev_pop(b) >= 1e-12"


@query("p09_suspended", "dropped first", "ebars", "x as (select symbol, case when volume % 4 = 0 then '0' else '1' end as s from ebars)", "select count(*) filter (s != '1') as dropped, min(symbol) filter (s != '1') as first from x")
def _(spark, d):
    b = P.events_bars(spark, d).withColumn("tradestatus", F.when(F.col("volume") % 4 == 0, F.lit("0")).otherwise(F.lit("1")))
    return A.drop_suspended(b)[1].select("dropped", F.get("sample", F.lit(0)).alias("first"))


@query("s20_sector_snapshot", "industry date:d amount:2", "bars dim", "x as (select industry, date, sum(amount) as amount from bars join dim using (symbol) group by 1, 2)", "select * from x where date <= date '2000-01-01'")
def _(spark, d):
    x = P.bars(spark, d).join(P.dimension(spark, d).select("symbol", "industry"), "symbol").groupBy("industry", "date").agg(F.sum("amount").alias("amount"))
    have = x.where("date <= date'2000-01-01'")
    return A.append_new_days(have, x.where("date = date'1999-12-01'").withColumn("amount", F.col("amount") * 2), ["date"])


@query("s21_market_totals", "date:d market amount:2", "bars dim", "x as (select market, date, sum(amount) as amount from bars join dim using (symbol) group by 1, 2)", "select * from x where date <= date '1999-06-01' or (date = date '1999-07-01' and market = 'SH')")
def _(spark, d):
    x = P.bars(spark, d).join(P.dimension(spark, d).select("symbol", "market"), "symbol").groupBy("market", "date").agg(F.sum("amount").alias("amount"))
    late = x.where("date between date'1999-05-01' and date'1999-07-01'").where("date < date'1999-07-01' or market = 'SH'")
    return A.append_new_days(x.where("date <= date'1999-06-01' and (date < date'1999-06-01' or market = 'SZ')"), late, ["date", "market"])


@query("s23_block_rows", "code n", "", "", "select case event_type when 'view' then 'V1' when 'click' then 'C1' end as code, count(*) as n from events where event_type in ('view', 'click') and cast(ts as date) > date '2024-01-10' group by 1")
def _(spark, d):
    import datetime

    e = P.read(spark, d, "events").select(F.col("event_type").alias("block"), F.to_date("ts").alias("date"))
    return A.map_blocks(e, {"view": "V1", "click": "C1"}, datetime.date(2024, 1, 10)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("s24_repaired_rows", "symbol n", "ebars", "m as (select symbol, max(date) as wm from ebars where date <= date '2024-01-20' group by symbol)", "select e.symbol, count(*) as n from ebars e left join m using (symbol) where wm is null or e.date > wm group by 1")
def _(spark, d):
    from tessera.sources import buckets
    from tessera.sources.scratch import shared_folder

    b, at = P.events_bars(spark, d), shared_folder(spark)
    old = b.where("date <= date'2024-01-20'")
    buckets.create(old, at, ["symbol", "date"], ["symbol"], 16)
    buckets.repair(b, at, "symbol", "date")
    added = buckets.read(spark, at).join(old.select("symbol", "date"), ["symbol", "date"], "left_anti")  # what the table has now beyond what it had
    return added.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("s25_factor_ic_store", "factor date:d ic:8", "bars", IC, "select factor, date, ic from ic where date between date '1999-01-01' and date '1999-12-31' and ic is not null")
def _(spark, d):
    from tessera.plans.evaluation import daily_ics
    from tessera.sources.scratch import shared_folder

    at = shared_folder(spark)
    daily_ics(spark, d).where("ic is not null").write.partitionBy("factor").parquet(at)
    return spark.read.parquet(at).where("date between date'1999-01-01' and date'1999-12-31'")


@query("b10_monthly_panel", "symbol date:d roe:6 ln_size:6 fwd_1:6", "bars fin dim", PIT + ",\n" + FWD, "select pit.symbol, pit.date, roe, ln_size, fwd_1 from pit join fwd using (symbol, date) where roe is not null and fwd_1 is not null")
def _(spark, d):
    return pit_panel(spark, d).join(W.forward_returns(P.bars(spark, d), (1,)), ["symbol", "date"]).where("roe is not null and fwd_1 is not null")


WINSOR = PIT + ",\n" + FWD + """, lq as (select date, quantile_cont(fwd_1, 0.01) as lo, quantile_cont(fwd_1, 0.99) as hi from fwd group by date),
mp as (select p.date, p.ep as v, least(greatest(f.fwd_1, lo), hi) as y, f.fwd_1 from pit p join fwd f using (symbol, date) join lq on lq.date = p.date)"""


@query("b11_monthly_evaluation", "date:d n ic:7 coverage:8", "bars fin dim", WINSOR + f""", mr as (select date, {RANK.format(k='date', v='v')} as a, {RANK.format(k='date', v='y')} as b from mp where v is not null and fwd_1 is not null),
mi as (select date, count(*) as n, case when {OK} then corr(a, b) end as ic from mr group by date), mc as (select date, count(v) / count(*)::double as coverage from mp group by date)""", "select mi.date, n, ic, coverage from mi join mc on mc.date = mi.date")
def _(spark, d):
    x = pit_panel(spark, d).join(W.forward_returns(P.bars(spark, d), (1,)), ["symbol", "date"])
    return A.monthly_eval(x, "ep", "fwd_1", LEAST)


@query("b12_score_history", "symbol date:d score:5 fwd_1:6 fwd_5:6 covered", "bars fin dim", COMPOSITE + ",\n" + FWD, "select symbol, date, score, fwd_1, fwd_5, score is not null as covered from cs join fwd using (symbol, date)")
def _(spark, d):
    return composite_panel(spark, d).join(W.forward_returns(P.bars(spark, d)), ["symbol", "date"]).withColumn("covered", F.col("score").isNotNull())


@query("b15_evaluation_frame", "symbol date:d rel:6 fwd_1:6", "bars", FWD + ", p as (select symbol, date, product(greatest(1 + coalesce(change_pct, 0) / 100, 1e-12)) over (partition by symbol order by date rows unbounded preceding) as p from bars)",
    "select symbol, date, p / last(p) over (partition by symbol order by date rows between unbounded preceding and unbounded following) as rel, fwd_1 from p join fwd using (symbol, date)")
def _(spark, d):
    b = P.bars(spark, d)
    last = F.max_by("close", "date").over(W.Window.partitionBy("symbol"))
    return W.adjusted_close(b).withColumn("rel", F.col("adj_close") / last).join(W.forward_returns(b, (1,)), ["symbol", "date"])


EXPR = FWD + ", hx as (select b.date, turnover * (high - low) / close as v, fwd_1 as y from bars b join fwd using (symbol, date) where fwd_1 is not null)"


@query("b16_hypothesis_backtest", "days ic_mean:7 win_rate:7", "bars", EXPR + f", hr as (select date, {RANK.format(k='date', v='v')} as a, {RANK.format(k='date', v='y')} as b from hx where date >= date '1998-01-01'), hi as (select date, corr(a, b) as ic from hr group by date having {OK})", "select count(*) as days, avg(ic) as ic_mean, avg(cast(ic > 0 as double)) as win_rate from hi")
def _(spark, d):
    b = P.bars(spark, d)
    x = b.join(W.forward_returns(b, (1,)), ["symbol", "date"]).where("date >= date'1998-01-01'")
    long = x.select("date", (F.col("turnover") * (F.col("high") - F.col("low")) / F.col("close")).alias("value"), F.col("fwd_1").alias("label"))
    return ic.ic_summary(ic.rank_ic(long, ["date"], least=LEAST).withColumn("all", F.lit(1)), ["all"])


@query("b20_out_of_sample_ic", "part days ic_mean:7", "bars", EXPR + f", hr as (select date, {RANK.format(k='date', v='v')} as a, {RANK.format(k='date', v='y')} as b from hx), hi as (select date, corr(a, b) as ic from hr group by date having {OK})", "select case when date >= date '2000-01-01' then 'held_out' else 'train' end as part, count(*) as days, avg(ic) as ic_mean from hi group by 1")
def _(spark, d):
    b = P.bars(spark, d)
    x = b.join(W.forward_returns(b, (1,)), ["symbol", "date"])
    long = x.select("date", (F.col("turnover") * (F.col("high") - F.col("low")) / F.col("close")).alias("value"), F.col("fwd_1").alias("label"))
    r = ic.rank_ic(long, ["date"], least=LEAST).where("ic is not null")
    return r.groupBy(F.when(F.col("date") >= F.lit("2000-01-01"), F.lit("held_out")).otherwise(F.lit("train")).alias("part")).agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic_mean"))


@query("b18_coverage_panel", "date:d universe valued coverage:8", "bars fin dim", PIT + ", pv as (select *, lag(close) over (partition by symbol order by date) as pc from pit)", "select date, count(*) filter (pc > 0) as universe, count(pb_inv) filter (pc > 0) as valued, count(pb_inv) filter (pc > 0) / greatest(count(*) filter (pc > 0), 1)::double as coverage from pv group by date")
def _(spark, d):
    x = pit_panel(spark, d).withColumn("pc", F.lag("close").over(W.sym()))
    u, v = F.count_if(F.col("pc") > 0), F.count(F.when(F.col("pc") > 0, F.col("pb_inv")))
    return x.groupBy("date").agg(u.alias("universe"), v.alias("valued"), (v / F.greatest(u, F.lit(1))).alias("coverage"))


_SUM = " + ".join(f"coalesce(z_{f} * case when '{f}' = 'roe_yy_chg' then k else 1 end, 0)" for f in FUSION)


@query("b29_weight_variants", "k n ic_mean:6", "bars fin dim", NEUTRAL + ",\n" + FWD + f""", vk as (select unnest([0.0e0, 0.5e0, 1.0e0]) as k), vs as (select k, r.date, round({_SUM}, 9) as v, fwd_1 as y from roe_yy_chg5 r join fwd using (symbol, date) cross join vk where fwd_1 is not null and z_pb_inv is not null),
vr as (select k, date, {RANK.format(k='k, date', v='v')} as a, {RANK.format(k='k, date', v='y')} as b from vs), vi as (select k, date, corr(a, b) as ic from vr group by 1, 2 having {OK})""", "select k, count(*) as n, avg(ic) as ic_mean from vi group by k")
def _(spark, d):
    x = neutral_panel(spark, d).join(W.forward_returns(P.bars(spark, d), (1,)), ["symbol", "date"]).where("fwd_1 is not null and z_pb_inv is not null")
    grid = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "k double")
    total = F.lit(0.0)
    for f in FUSION:
        total = total + F.coalesce(F.col(f"z_{f}") * (F.col("k") if f == "roe_yy_chg" else F.lit(1.0)), F.lit(0.0))
    y = x.crossJoin(F.broadcast(grid)).select("k", "date", F.round(total, 9).alias("value"), F.col("fwd_1").alias("label"))
    return ic.rank_ic(y, ["k", "date"], least=LEAST).where("ic is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic_mean"))


@query("b48_aligned_blocks", "window days rows", "bars", "r as (select cast(year(date) as integer) as w, cast(symbol as integer) % 4 as c, date, avg(change_pct) as ret from bars group by 1, 2, 3), f as (select w from (select w, c from r group by 1, 2 having count(ret) >= 3) group by w having count(*) = 4), x as (select r.* from r join f using (w) where ret is not null qualify count(*) over (partition by w, date) = 4), dd as (select w, count(distinct date) as days, count(*) as rows from x group by w having count(distinct date) >= 10), k as (select *, row_number() over (order by w desc) as k, count(*) over () as n from dd)",
    'select w as "window", days, rows from k where k <= n - n % 2')
def _(spark, d):
    r = P.bars(spark, d).groupBy(F.year("date").alias("window"), (F.col("symbol").cast("int") % 4).alias("config"), "date").agg(F.avg("change_pct").alias("ret"))
    return A.rectangular_blocks(r).groupBy("window").agg(F.countDistinct("date").alias("days"), F.count(F.lit(1)).alias("rows"))


@query("b60_day_assembly", "date:d bars events status", "bars", "l as (select cast(date_trunc('month', o_orderdate) as date) as date, count(*) as events from orders where o_orderstatus = 'P' group by 1), b as (select date, count(*) as bars from bars where volume > 60 group by date), dy as (select distinct date from bars)",
    "select dy.date, coalesce(bars, 0) as bars, coalesce(events, 0) as events, case when bars > 0 and events > 0 then 'complete' when coalesce(bars, 0) = 0 and coalesce(events, 0) = 0 then 'missing' else 'partial' end as status from dy left join b on b.date = dy.date left join l on l.date = dy.date")
def _(spark, d):
    b = P.bars(spark, d)
    o = P.read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.trunc("o_orderdate", "month").alias("date"))
    return A.assemble_days(b, {"bars": b.where("volume > 60"), "events": o})


@query("b61_daily_evidence", "date:d turnover:7 cost:4", "bars fills", PORT + ", fc as (select cast(date_trunc('month', date) as date) as date, sum(greatest(qty * fill_price * 0.00025e0, 5) + case side when 'sell' then qty * fill_price * 0.0005e0 else 0 end + qty * fill_price * 0.00001e0) as cost from fills group by 1)", "select port.date, turnover, fc.cost from port join fc on fc.date = port.date")
def _(spark, d):
    c = B.fill_costs(P.fills(spark, d)).groupBy(F.trunc("date", "month").alias("date")).agg(F.sum("explicit_cost").alias("cost"))
    return portfolio(spark, d).select("date", "turnover").join(c, "date")


@query("b63_profile_history", "run rows null_change_pct:8", "bars", "", "select 'a' as run, count(*) as rows, 1 - count(change_pct) / count(*)::double as null_change_pct from bars union all select 'b', count(*), 1 - count(change_pct) / count(*)::double from bars where date <= date '1999-01-01'")
def _(spark, d):
    b = P.bars(spark, d)
    stats = lambda x, n: quality.table_stats(x, "date", ["symbol", "date"], ["change_pct"]).withColumn("run", F.lit(n))
    return stats(b, "a").unionByName(stats(b.where("date <= date'1999-01-01'"), "b"))


@query("b71_factor_day_metrics", "date:d factor n ic:8 spread:8", "bars", IC + """, p as (select date, factor, label, count(*) over (partition by date, factor) as m, row_number() over (partition by date, factor order by value desc, symbol) as t, row_number() over (partition by date, factor order by value, symbol) as l from long where value is not null and label is not null),
ls as (select date, factor, (avg(label) filter (t <= greatest(floor(m * 0.2e0), 1)) - avg(label) filter (l <= greatest(floor(m * 0.2e0), 1))) * case factor when 'vol20' then -1 else 1 end as spread from p where m >= 5 group by 1, 2)""", "select ic.date, ic.factor, n, ic, spread from ic left join ls on ls.date = ic.date and ls.factor = ic.factor")
def _(spark, d):
    x = scores_long(spark, d)
    s = ic.long_short(x, ["date", "factor"], least=LEAST, direction=F.when(F.col("factor") == "vol20", -1).otherwise(1)).select("date", "factor", "spread")
    return ic.rank_ic(x, ["date", "factor"], least=LEAST).join(s, ["date", "factor"], "left")


@query("b72_matured_state", "date:d factor n ic:8", "bars", IC, "select date, factor, n, ic from ic where date + 31 <= date '2000-06-15'")
def _(spark, d):
    x = scores_long(spark, d)
    return A.matured_state(x.select("date", "symbol", "factor", "value"), x.where("factor = 'mom20'").select("date", "symbol", "label"), F.lit("2000-06-15").cast("date"), 31)


@query("b79_recent_samples", "date:d trades ret:6", "ebars", "p as (select date, avg(close) as ret from ebars group by date order by date desc limit 5)", "select p.date, count(*) as trades, p.ret from events e join p on p.date = cast(e.ts as date) group by 1, 3")
def _(spark, d):
    perf = P.events_bars(spark, d).groupBy("date").agg(F.avg("close").alias("ret"))
    t = P.read(spark, d, "events").select(F.to_date("ts").alias("date"), "event_id")
    return A.recent_samples(perf, t, 5).groupBy("date", "ret").agg(F.count(F.lit(1)).alias("trades"))


@query("b83_realised_scores", "bucket mean_return:7 days", "bars fin dim", COMPOSITE + ",\n" + FWD + """, rs as (select cs.date, round(score, 9) as v, fwd_1 as y from cs join fwd using (symbol, date) where score is not null and fwd_1 is not null), rq as (select date, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) as q from rs group by date),
rm as (select rs.date, len(list_filter(q, lambda a: round(a, 9) < v)) + 1 as bucket, avg(y) as m from rs join rq on rq.date = rs.date group by 1, 2)""", "select cast(bucket as integer) as bucket, avg(m) as mean_return, count(*) as days from (select *, count(*) over (partition by date) as f from rm) where f = 5 group by bucket")
def _(spark, d):
    x = composite_panel(spark, d).withColumn("score", F.round("score", 9)).join(W.forward_returns(P.bars(spark, d), (1,)), ["symbol", "date"]).where("score is not null and fwd_1 is not null")
    cuts = F.percentile("score", F.array(*[F.lit(i / 5) for i in range(1, 5)])).over(W.Window.partitionBy("date"))
    y = x.withColumn("bucket", F.size(F.filter(cuts, lambda q: F.round(q, 9) < F.col("score"))) + 1).groupBy("date", "bucket").agg(F.avg("fwd_1").alias("m"))
    y = y.withColumn("f", F.count(F.lit(1)).over(W.Window.partitionBy("date"))).where("f = 5")
    return y.groupBy("bucket").agg(F.avg("m").alias("mean_return"), F.count(F.lit(1)).alias("days"))


@query("b85_watch_report", "date:d defined pool", "bars fin dim", WATCHED + f", ws as ({WATCH_SCORE})", "select date, count(watch) as defined, count(*) as pool from ws group by date")
def _(spark, d):
    x = xsec.watch_score(xsec.neutralize(pit_panel(spark, d), WATCH, least=LEAST))
    return x.groupBy("date").agg(F.count("watch").alias("defined"), F.count(F.lit(1)).alias("pool"))


@query("b87_neutral_ic", "factor n ic_mean:6", "bars fin dim", NEUTRAL + ",\n" + FWD + f""", ne as (select r.date, u.factor, round(u.v, 9) as v, fwd_1 as y from roe_yy_chg5 r join fwd using (symbol, date), lateral (values ('z_pb_inv', z_pb_inv), ('z_ep', z_ep)) u(factor, v) where u.v is not null and fwd_1 is not null),
nr as (select factor, date, {RANK.format(k='factor, date', v='v')} as a, {RANK.format(k='factor, date', v='y')} as b from ne), ni as (select factor, date, corr(a, b) as ic from nr group by 1, 2 having {OK})""", "select factor, count(*) as n, avg(ic) as ic_mean from ni group by factor")
def _(spark, d):
    x = neutral_panel(spark, d).join(W.forward_returns(P.bars(spark, d), (1,)), ["symbol", "date"])
    long = xsec.melt(x.select("date", "symbol", F.col("fwd_1").alias("label"), F.round("z_pb_inv", 9).alias("z_pb_inv"), F.round("z_ep", 9).alias("z_ep")), ["date", "symbol", "label"], ["z_pb_inv", "z_ep"])
    return ic.rank_ic(long, ["factor", "date"], least=LEAST).where("ic is not null").groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic_mean"))


@query("b98_common_days", "date:d n excess:7", "bars", FWD + ",\n" + TOP + ", cd as (select date from bars where month(date) % 2 = 0 intersect select date from wt)", "select f.date, count(w.symbol) as n, avg(fwd_1) filter (w.symbol is not null) - avg(fwd_1) as excess from fwd f join cd on cd.date = f.date left join wt w on w.date = f.date and w.symbol = f.symbol where fwd_1 is not null group by 1")
def _(spark, d):
    b, w = P.bars(spark, d), top_weights(spark, d)
    days = b.where("month(date) % 2 = 0").select("date").intersect(w.select("date"))
    x = W.forward_returns(b, (1,)).where("fwd_1 is not null").join(F.broadcast(days), "date", "left_semi").join(w.select("date", "symbol", F.lit(1).alias("held")), ["date", "symbol"], "left")
    return x.groupBy("date").agg(F.count("held").alias("n"), (F.avg(F.when(F.col("held") == 1, F.col("fwd_1"))) - F.avg("fwd_1")).alias("excess"))
