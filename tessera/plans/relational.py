"""Queries over scans, filters, joins, aggregates, rankings and scalar functions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import pit
from tessera.operators import relational as R
from tessera.operators import windows as W
from tessera.operators.quantiles import exact_quantiles
from tessera.plans.registry import query
from tessera.plans.windows import sql_frame
from tessera.sources import panels as P


@query("s02_recent_window", "symbol date:d volume turnover:6", "bars", "", "select * from bars where date >= (select max(date) from bars) - 200")
def _(spark, d):
    # the raw column's latest day gives the months that are needed, so older ones are never read
    top = R.latest(P.read(spark, d, "lineitem"), "l_shipdate")
    before = datetime.date(top.year, top.month, 1) - datetime.timedelta(201)
    return P.bars(spark, d, since=datetime.date(before.year + before.month // 12, before.month % 12 + 1, 1))


@query("s03_day_section", "symbol date:d volume turnover:6", "bars", "", "select * from bars where date = date '1998-03-01'")
def _(spark, d):
    return P.bars(spark, d).where("date = date'1998-03-01'")


@query("s04_close_range", "symbol date:d volume turnover:6", "bars", "", "select * from bars where date between date '1997-01-01' and date '1998-12-31' and close > 0")
def _(spark, d):
    return P.bars(spark, d).where("date between date'1997-01-01' and date'1998-12-31' and close > 0")


@query("s05_decision_guard", "date:d n volume", "bars", "", "select date, count(*) as n, sum(volume) as volume from bars where date <= date '1999-06-15' group by date")
def _(spark, d):
    return R.up_to(P.bars(spark, d), "1999-06-15").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("s06_trading_days", "date:d symbols", "ebars", "", "select date, count(distinct symbol) as symbols from ebars group by date")
def _(spark, d):
    return P.events_bars(spark, d).groupBy("date").agg(F.countDistinct("symbol").alias("symbols"))


@query("s07_close_up_to", "symbol date:d close:4", "ebars", "", "select symbol, max(date) as date, arg_max(close, date) as close from ebars where date <= date '2024-01-15' group by symbol")
def _(spark, d):
    return R.up_to(P.events_bars(spark, d), "2024-01-15").groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


@query("s08_prices_for", "symbol close:4", "ebars", "", "select symbol, close from ebars where date = date '2024-01-10' and symbol in ('000003', '000007', '000011')")
def _(spark, d):
    return P.events_bars(spark, d).where("date = date'2024-01-10'").where(F.col("symbol").isin("000003", "000007", "000011"))


@query("p01_codes", "symbol market canon back limit_rate", "dim", "", """select symbol, market, lpad(split_part(symbol || '.' || market, '.', 1), 6, '0') as canon,
    symbol || case when left(symbol, 1) in ('6', '9') then '.SH' when left(symbol, 1) in ('4', '8') then '.BJ' else '.SZ' end as back,
    case when regexp_matches(upper(mark), 'ST|退') then 0.05e0 when left(symbol, 2) in ('30', '68') then 0.2e0 when left(symbol, 1) in ('4', '8') then 0.3e0 else 0.1e0 end as limit_rate from dim""")
def _(spark, d):
    x = P.dimension(spark, d)
    full = F.concat_ws(".", F.regexp_replace("symbol", "^0{1,3}", ""), "market")
    return x.select("symbol", "market", S.canonical_code(full).alias("canon"), S.suffixed_code("symbol").alias("back"), S.daily_limit(F.col("symbol"), F.col("mark")).alias("limit_rate"))


UNIVERSE = """u0 as (select b.symbol, b.date, d.mark || 'name' as name, d.is_st, d.list_date, b.close * d.float_shares / 1e5 as float_cap, b.turnover, b.amount from bars b join dim d using (symbol) where b.date = date '1998-03-01'),
u1 as (select * from u0 where symbol like '0000%' and not coalesce(regexp_matches(name, 'ST|退'), false) and not coalesce(is_st, false)),
uf as (select coalesce(median(float_cap) > 1e6, false) as big, count(list_date) > 0 as dated from u1)"""


@query("p03_universe", "symbol name float_cap:4 list_date:d", "bars dim", UNIVERSE, """select u1.* from u1, uf where case when big then float_cap / 1e8 else float_cap end between 50 and 2000 and turnover >= 0.5 and amount > 0
    and (not dated or list_date is null or date '1998-03-01' - list_date >= 120)""")
def _(spark, d):
    x = P.bars(spark, d).where("date = date'1998-03-01'").join(P.dimension(spark, d), "symbol")
    x = x.select("symbol", "date", F.concat("mark", F.lit("name")).alias("name"), "is_st", "list_date", (F.col("close") * F.col("float_shares") / 1e5).alias("float_cap"), "turnover", "amount")
    return R.filter_universe(x, "1998-03-01", ["0000"], (50.0, 2000.0), 0.5)


@query("p05_no_limit_moves", "date:d n", "bars", "", "select date, count(*) as n from bars where abs(change_pct) <= 9.5 group by date")
def _(spark, d):
    return P.bars(spark, d).where("abs(change_pct) <= 9.5").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("p07_limit_prices", "symbol date:d limit_up:2 limit_down:2", "bars", "", "select symbol, date, round(lag(close) over w * 1.1, 2) as limit_up, round(lag(close) over w * 0.9, 2) as limit_down from bars where volume > 60 window w as (partition by symbol order by date)")
def _(spark, d):
    return R.limit_prices(P.bars(spark, d).where("volume > 60"), F.lit(0.1))


@query("p08_known_bad_rows", "date:d n", "bars dim", "", "select date, count(*) as n from bars b where not exists (select 1 from dim d where d.symbol = b.symbol and d.is_st and month(b.date) = 1) group by date")
def _(spark, d):
    b = P.bars(spark, d)
    bad = b.select("symbol", "date").where("month(date) = 1").join(P.dimension(spark, d).where("is_st").select("symbol"), "symbol")
    return b.join(bad, ["symbol", "date"], "left_anti").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("p11_age_filter", "symbol date:d age", "ebars", "c as (select date, row_number() over (order by date) as i from (select distinct date from ebars))",
    "select e.symbol, e.date, cast(c.i - min(c.i) over (partition by symbol) as integer) as age from ebars e join c on c.date = e.date qualify c.i - min(c.i) over (partition by symbol) >= 10")
def _(spark, d):
    b = P.events_bars(spark, d)
    x = b.join(F.broadcast(P.calendar(b)), "date")
    return x.withColumn("age", (F.col("idx") - F.min("idx").over(W.Window.partitionBy("symbol"))).cast("int")).where("age >= 10")


@query("p12_month_ends", "month:d last:d", "ebars", "", "select date_trunc('month', date) as month, max(date) as last from ebars group by 1")
def _(spark, d):
    return P.events_bars(spark, d).groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("last"))


@query("p13_session_distance", "symbol last:d distance", "ebars", "c as (select date, row_number() over (order by date) as i from (select distinct date from ebars)), l as (select symbol, max(date) as last from ebars group by symbol)",
    "select symbol, last, cast((select max(i) from c) - c.i as integer) as distance from l join c on c.date = l.last")
def _(spark, d):
    b = P.events_bars(spark, d)
    cal = P.calendar(b)
    x = b.groupBy("symbol").agg(F.max("date").alias("last")).join(F.broadcast(cal.select(F.col("date").alias("last"), "idx")), "last")
    return x.crossJoin(F.broadcast(cal.agg(F.max("idx").alias("top")))).select("symbol", "last", (F.col("top") - F.col("idx")).cast("int").alias("distance"))


@query("p14_board_kpis", "date:d n median:6 up amount:2", "bars", "", "select date, count(*) as n, median(change_pct) as median, cast(count(*) filter (change_pct > 0) as bigint) as up, sum(amount) as amount from bars where date = (select max(date) from bars) group by date")
def _(spark, d):
    x = R.recent_window(P.bars(spark, d), 0)
    return x.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.median("change_pct").alias("median"), F.count_if(F.col("change_pct") > 0).alias("up"), F.sum("amount").alias("amount"))


@query("j01_dimension_join", "industry date:d n amount:2", "bars dim", "", "select industry, date, count(*) as n, sum(amount) as amount from bars join dim using (symbol) where is_active group by 1, 2")
def _(spark, d):
    x = P.bars(spark, d).join(P.dimension(spark, d).where("is_active").select("symbol", "industry"), "symbol")
    return x.groupBy("industry", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("j02_fill_join", "symbol date:d change_pct:5", "bars", "", "select symbol, date, coalesce(case when volume % 3 != 0 then change_pct end, turnover) as change_pct from bars")
def _(spark, d):
    b = P.bars(spark, d)
    holes = b.select("symbol", "date", F.when(F.col("volume") % 3 != 0, F.col("change_pct")).alias("change_pct"))
    return pit.checked_left_join(holes, b.select("symbol", "date", F.col("turnover").alias("patch")), ["symbol", "date"], {"change_pct": "patch"})


@query("j05_latest_within", "symbol date:d volume", "bars", "", "select symbol, date, volume from bars where date <= date '1999-01-01' and date > date '1999-01-01' - 400 qualify row_number() over (partition by symbol order by date desc) = 1")
def _(spark, d):
    import datetime

    return pit.latest_within(P.bars(spark, d), "symbol", "date", datetime.date(1999, 1, 1), 400, "close")


@query("j06_patch_value", "symbol v:5", "bars", "", "select symbol, arg_max(v, date) filter (v is not null) as v from (select *, case when volume % 5 = 0 then change_pct end as v from bars) group by symbol")
def _(spark, d):
    return pit.patch_value(P.bars(spark, d).withColumn("v", F.when(F.col("volume") % 5 == 0, F.col("change_pct"))), "symbol", "date", "v")


@query("j08_gated_snapshot", "symbol date:d close:4", "ebars", "g as (select date from ebars group by date having count(*) >= 20 and count(close) / count(*)::double >= 0.8 and count(*) filter (symbol like '00000%') > 0), m as (select max(date) as best from g)",
    "select symbol, date, close from ebars, m where case when best is not null then date = best else true end qualify best is not null or date = max(date) over (partition by symbol)")
def _(spark, d):
    return pit.quality_gated(P.events_bars(spark, d), "date", "close", 20, 0.8, "00000")


@query("j10_semi_anti", "symbol n first:d last:d", "ebars", "r as (select distinct symbol from ebars where date >= date '2024-01-25')", "select symbol, count(*) as n, min(date) as first, max(date) as last from ebars where symbol not in (select symbol from r) or symbol in ('000001', '000002') group by symbol")
def _(spark, d):
    b = P.events_bars(spark, d)
    alive = b.where("date >= date'2024-01-25'").select("symbol").distinct()
    some = spark.createDataFrame([("000001",), ("000002",)], "symbol string")
    x = b.join(alive, "symbol", "left_anti").union(b.join(F.broadcast(some), "symbol", "left_semi")).distinct()
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


OTHER = "o as (select symbol, date, close * case when volume % 10 = 0 then 1.001 else 1 end as close, volume * case when volume % 7 = 0 then 100 else 1 end as volume from bars where volume % 13 != 0)"


def other(b):
    v = F.col("volume")
    return b.where(v % 13 != 0).select("symbol", "date", (F.col("close") * F.when(v % 10 == 0, 1.001).otherwise(1.0)).alias("close"), (v * F.when(v % 7 == 0, 100).otherwise(1)).alias("volume"))


@query("j12_reconcile", "common only_left only_right diff_close ratio_close:8 diff_volume ratio_volume:6", "bars", OTHER, """select count(*) filter (b.symbol is not null and o.symbol is not null) as common, count(*) filter (o.symbol is null) as only_left, count(*) filter (b.symbol is null) as only_right,
    count(*) filter (abs(b.close - o.close) > 0.01) as diff_close, avg(b.close / o.close) as ratio_close, count(*) filter (abs(b.volume - o.volume) > 0.5) as diff_volume, avg(b.volume / o.volume) as ratio_volume
    from bars b full outer join o on o.symbol = b.symbol and o.date = b.date""")
def _(spark, d):
    b = P.bars(spark, d)
    return R.reconcile(b, other(b), ["symbol", "date"], {"close": 0.01, "volume": 0.5})


@query("j13_key_differences", "side n", "bars", OTHER, "select case when o.symbol is null then 'left' when b.symbol is null then 'right' else 'both' end as side, count(*) as n from bars b full outer join o on o.symbol = b.symbol and o.date = b.date group by 1")
def _(spark, d):
    b = P.bars(spark, d)
    x = b.select("symbol", "date", F.lit(1).alias("l")).join(other(b).select("symbol", "date", F.lit(1).alias("r")), ["symbol", "date"], "full_outer")
    return x.groupBy(F.when(F.col("r").isNull(), F.lit("left")).when(F.col("l").isNull(), F.lit("right")).otherwise(F.lit("both")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("j14_holding_events", "symbol buy_date:d ex_date:d", "ebars", "p as (select symbol, min(date) as buy_date from ebars group by symbol), e as (select symbol, date as ex_date from ebars where volume >= 5)",
    "select p.symbol, buy_date, ex_date from p join e on e.symbol = p.symbol and ex_date between buy_date and date '2024-01-20' where right(p.symbol, 1) != '3'")
def _(spark, d):
    b = P.events_bars(spark, d)
    p, e = b.groupBy("symbol").agg(F.min("date").alias("buy_date")), b.where("volume >= 5").select("symbol", F.col("date").alias("ex_date"))
    return pit.holding_events(p, e, e.where("right(symbol, 1) = '3'"), "2024-01-20")


@query("j15_ratio_buckets", "date:d bucket n", "bars", OTHER, "select b.date, case when b.volume = 0 or o.volume = 0 then 'zero' when abs(b.volume / o.volume - 1) < 0.05 then '~1' when abs(b.volume / o.volume * 100 - 1) < 0.05 then '~0.01' when abs(b.volume / o.volume / 100 - 1) < 0.05 then '~100' else 'other' end as bucket, count(*) as n from bars b join o on o.symbol = b.symbol and o.date = b.date group by 1, 2")
def _(spark, d):
    b = P.bars(spark, d)
    return R.ratio_buckets(b, other(b), ["symbol", "date"], "volume")


@query("a01_market_breadth", "date:d total up down flat limit_up limit_down amount:2 avg_change:6 breadth:8", "bars", "", """select date, count(*) as total, count(*) filter (change_pct > 0) as up, count(*) filter (change_pct < 0) as down, count(*) filter (change_pct = 0) as flat, count(*) filter (change_pct >= 9.5) as limit_up,
    count(*) filter (change_pct <= -9.5) as limit_down, sum(amount) as amount, avg(change_pct) as avg_change, (count(*) filter (change_pct > 0) - count(*) filter (change_pct < 0)) / count(*)::double as breadth from bars where change_pct is not null group by date""")
def _(spark, d):
    return R.market_breadth(P.bars(spark, d))


@query("a02_sentiment", "date:d n up:8 median:6 strong:8 limit_up:8 amount:2 score:6", "bars", "s as (select date, count(*) as n, avg(cast(change_pct > 0 as double)) as up, median(change_pct) as median, avg(cast(change_pct >= 3 as double)) as strong, avg(cast(change_pct >= 9.5 as double)) as limit_up, sum(amount) as amount from bars where change_pct is not null group by date)",
    "select *, least(greatest(100 * (0.35 * up + 0.25 * least(greatest((median + 5) / 10, 0), 1) + 0.25 * strong + 0.15 * least(greatest(limit_up * 10, 0), 1)), 1), 99) as score from s")
def _(spark, d):
    return R.sentiment(P.bars(spark, d))


@query("a03_equal_weight_return", "date:d ret:6", "bars", "", "select date, avg(change_pct) as ret from bars group by date")
def _(spark, d):
    return P.bars(spark, d).groupBy("date").agg(F.avg("change_pct").alias("ret"))


@query("a07_freshness_lag", "symbol lag", "ebars", "c as (select distinct date from ebars)", "select symbol, count(c.date) as lag from (select symbol, max(date) as m from ebars group by symbol) s left join c on c.date > s.m and c.date <= date '2024-01-30' group by symbol")
def _(spark, d):
    b = P.events_bars(spark, d)
    cal = P.calendar(b)
    at = b.groupBy("symbol").agg(F.max("date").alias("date")).join(F.broadcast(cal), "date")
    return at.crossJoin(F.broadcast(cal.where("date <= date'2024-01-30'").agg(F.max("idx").alias("top")))).select("symbol", (F.col("top") - F.col("idx")).cast("long").alias("lag"))


@query("a08_unregistered", "prefix symbols first:d last:d rows", "bars dim", "", "select left(symbol, 5) as prefix, count(distinct symbol) as symbols, min(date) as first, max(date) as last, count(*) as rows from bars where symbol not in (select symbol from dim where is_active) group by 1")
def _(spark, d):
    x = P.bars(spark, d).join(P.dimension(spark, d).where("is_active").select("symbol"), "symbol", "left_anti")
    return x.groupBy(F.substring("symbol", 1, 5).alias("prefix")).agg(F.countDistinct("symbol").alias("symbols"), F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("rows"))


ADV = "dd as (select distinct date from bars order by date desc limit 20), av as (select symbol, avg(amount) as adv, count(change_pct) as n, stddev_samp(change_pct) as s from bars where date in (select date from dd) group by symbol), adv as (select symbol, adv, n, case when n >= 5 then s / 100 else 0.025 end * sqrt(252) as vol, case when n >= 5 then 'sample' else 'fallback' end as vol_source from av)"


@query("a09_adv_vol", "symbol adv:4 n vol:7 vol_source", "bars", ADV, "select * from adv")
def _(spark, d):
    return R.adv_vol(P.bars(spark, d))


@query("a10_rejections", "date:d total blocked rate:8", "fills", "", "select date, count(*) as total, count(*) filter (qty % 100 != 0 and tax > 0.06) as blocked, count(*) filter (qty % 100 != 0 and tax > 0.06) / count(*)::double as rate from fills group by date")
def _(spark, d):
    bad = (F.col("qty") % 100 != 0) & (F.col("tax") > 0.06)
    return P.fills(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("blocked"), (F.count_if(bad) / F.count(F.lit(1))).alias("rate"))


@query("a11_slippage", "side n mean:8 p50:8 p95:8 worst:8", "fills", "x as (select side, (fill_price / decision_price - 1) * case side when 'buy' then 1 else -1 end as s from fills)", "select side, count(*) as n, avg(s) as mean, quantile_cont(s, 0.5) as p50, quantile_cont(s, 0.95) as p95, max(s) as worst from x group by side")
def _(spark, d):
    s = (F.col("fill_price") / F.col("decision_price") - 1) * F.when(F.col("side") == "buy", 1).otherwise(-1)
    x = P.fills(spark, d).select("side", s.alias("s"))
    q = exact_quantiles(x, "s", (0.5, 0.95), ("side",)).select("side", F.col("q0").alias("p50"), F.col("q1").alias("p95"))
    return x.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean"), F.max("s").alias("worst")).join(q, "side")


@query("a12_participation", "p50:8 p95:8 most:2", "bars fills", ADV + ", x as (select qty * fill_price as v, qty * fill_price / adv as p from fills join adv using (symbol))", "select quantile_cont(p, 0.5) as p50, quantile_cont(p, 0.95) as p95, max(v) as most from x")
def _(spark, d):
    x = P.fills(spark, d).join(R.adv_vol(P.bars(spark, d)), "symbol").select((F.col("qty") * F.col("fill_price")).alias("v"), "adv")
    q = exact_quantiles(x, F.col("v") / F.col("adv"), (0.5, 0.95)).select(F.col("q0").alias("p50"), F.col("q1").alias("p95"))
    return x.agg(F.max("v").alias("most")).crossJoin(F.broadcast(q))


@query("a13_cost_by_notional", "bucket n cost:8", "fills", "", "select floor(qty * fill_price / 20000) * 20000 as bucket, count(*) as n, avg(tax) as cost from fills group by 1")
def _(spark, d):
    b = (F.floor(F.col("qty") * F.col("fill_price") / 20000) * 20000).cast("double")
    return P.fills(spark, d).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("tax").alias("cost"))


@query("a14_tag_counts", "tag n", "", "t as (select unnest(string_split(p_name || ' ' || p_type, ' ')) as tag from part)", "select tag, count(*) as n from t group by tag order by n desc, tag limit 12")
def _(spark, d):
    p = P.read(spark, d, "part")
    return R.tag_counts(p.select(F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tags")), "tags", 12)


@query("a15_duplicate_keys", "l_orderkey l_linenumber n", "", "", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def _(spark, d):
    return P.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a19_concentration", "date:d n hhi:9 normalised:8", "bars", "w as (select date, amount / sum(amount) over (partition by date) as w from bars), h as (select date, count(*) as n, sum(w * w) as hhi from w group by date)", "select *, case when n > 1 then (hhi - 1.0e0 / n) / (1 - 1.0e0 / n) end as normalised from h")
def _(spark, d):
    x = P.bars(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("amount") * F.col("amount")) / F.pow(F.sum("amount"), F.lit(2))).alias("hhi"))
    return x.withColumn("normalised", F.when(F.col("n") > 1, (F.col("hhi") - 1 / F.col("n")) / (1 - 1 / F.col("n"))))


@query("a20_worst_status", "symbol status", "bars", "", "select symbol, case max(case when change_pct is null then 2 when abs(change_pct) > 50 then 3 when abs(change_pct) > 20 then 1 else 0 end) when 3 then 'invalid' when 2 then 'missing' when 1 then 'pending' else 'ok' end as status from bars group by symbol")
def _(spark, d):
    c = F.col("change_pct")
    rank = F.when(c.isNull(), 2).when(F.abs(c) > 50, 3).when(F.abs(c) > 20, 1).otherwise(0)
    return P.bars(spark, d).groupBy("symbol").agg(F.element_at(F.array(*map(F.lit, ("ok", "pending", "missing", "invalid"))), F.max(rank) + 1).alias("status"))


RANKED = """fs as (select symbol, date, turnover, case when change_pct is not null then least(greatest(1 - abs(change_pct) / 10, -1), 1) end as f_govern, avg(change_pct) {f} as mom from bars),
pr as (select *, count(f_govern) over (partition by date) as ng, count(*) over (partition by date) as n, rank() over (partition by date, f_govern is null order by f_govern) + (count(*) over (partition by date, f_govern) - 1) / 2.0e0 as rg,
    rank() over (partition by date order by turnover) + (count(*) over (partition by date, turnover) - 1) / 2.0e0 as rt from fs),
sc as (select symbol, date, 0.4e0 * coalesce(case when f_govern is not null and ng > 1 then (rg - 1) / (ng - 1) end, 0.5) + 0.6e0 * coalesce(case when n > 1 then (rt - 1) / (n - 1) end, 0.5) as score from pr)""".format(f=sql_frame(20))


@query("t01_selection", "date:d symbol score:6 rank", "bars", RANKED, "select date, symbol, score, cast(row_number() over (partition by date order by round(score, 9) desc, symbol) as integer) as rank from sc qualify row_number() over (partition by date order by round(score, 9) desc, symbol) <= 10")
def _(spark, d):
    x = W.factor_scores(P.bars(spark, d))
    w = {"f_govern": 0.4, "f_liquidity": 0.6}
    for c in w:
        x = x.withColumn(f"p_{c}", S.rank_percentile(c, "date"))
    return R.top_n(x.withColumn("score", F.round(0.4 * F.col("p_f_govern") + 0.6 * F.col("p_f_liquidity"), 9)), "score", 10, "date")


def percentile_sql(c: str) -> str:
    return f"coalesce(case when {c} is not null and count({c}) over (partition by date) > 1 then (rank() over (partition by date, {c} is null order by {c}) + (count(*) over (partition by date, {c}) - 1) / 2.0e0 - 1) / (count({c}) over (partition by date) - 1) end, 0.5)"


@query("t01_weighted_components", "date:d symbol score:8 rank", "bars",
    f"""fx as (select *, avg(change_pct) {sql_frame(20)} as mom20, avg(change_pct * change_pct) {sql_frame(20)} as sq, avg(close) {sql_frame(20)} as sma20, avg(close) {sql_frame(60)} as sma60 from bars),
fy as (select *, case when mom20 is not null then sqrt(greatest(sq - mom20 * mom20, 0)) end as vol20, cast(close > sma20 as int) + cast(sma20 > sma60 as int) as up, cast(close < sma20 as int) + cast(sma20 < sma60 as int) as dn from fx),
fz as (select symbol, date, (up - dn) * turnover as f_signal, case when up = 2 then 1.0e0 when dn = 2 then -1.0e0 else 0.0e0 end as f_trend, case when change_pct is not null then least(greatest(1 - abs(change_pct) / 10, -1), 1) end as f_govern, turnover as f_liquidity,
    case when coalesce(vol20, 0) = 0 then 0 else 1 - least(1, vol20 / 5) end as f_vol, -mom20 / 5 as f_mom_rev from fy),
fs as (select date, symbol, round({' + '.join(f'{w}e0 * {percentile_sql(c)}' for c, w in R.SELECT_WEIGHTS.items())}, 9) as score from fz)""",
    "select date, symbol, score, cast(row_number() over (partition by date order by score desc, symbol) as integer) as rank from fs qualify row_number() over (partition by date order by score desc, symbol) <= 10")
def _(spark, d):
    return R.selection(W.factor_scores(P.bars(spark, d)))


@query("t02_stable_rank", "date:d symbol rank", "bars", "", "select date, symbol, cast(row_number() over (partition by date order by change_pct desc nulls last, symbol) as integer) as rank from bars")
def _(spark, d):
    return R.top_n(P.bars(spark, d), "change_pct", 10**9, "date")


@query("t04_hot_tags", "tag n", "bars dim", "m as (select symbol from bars where date = (select max(date) from bars) order by amount desc, symbol limit 30)", "select 'industry ' || industry as tag, count(*) as n from m join dim using (symbol) group by 1 order by n desc, tag limit 8")
def _(spark, d):
    m = R.recent_window(P.bars(spark, d), 0).orderBy(F.desc("amount"), "symbol").limit(30)
    x = m.join(P.dimension(spark, d), "symbol").select(F.array(F.concat(F.lit("industry "), F.col("industry"))).alias("tags"))
    return R.tag_counts(x, "tags", 8)


@query("t05_latest_days", "symbol date:d", "bars", "", "select symbol, date from bars where date in (select distinct date from bars order by date desc limit 20)")
def _(spark, d):
    return P.bars(spark, d).withColumn("k", F.dense_rank().over(W.Window.partitionBy("symbol").orderBy(F.desc("date")))).join(F.broadcast(P.calendar(P.bars(spark, d)).orderBy(F.desc("date")).limit(20).select("date")), "date").drop("k")


@query("t06_gain_days", "curve_id top_share:8 best_run:6 worst_run:6", "bars", "c as (select left(symbol, 5) as curve_id, date, avg(change_pct) as ret from bars where change_pct is not null group by 1, 2), r as (select *, row_number() over (partition by curve_id order by ret desc, date) as t, sum(ret) over (partition by curve_id order by date rows between 4 preceding and current row) as run, row_number() over (partition by curve_id order by date) as k from c)",
    "select curve_id, sum(ret) filter (t <= 5 and ret > 0) / sum(ret) filter (ret > 0) as top_share, max(run) filter (k >= 5) as best_run, min(run) filter (k >= 5) as worst_run from r group by curve_id")
def _(spark, d):
    c = P.bars(spark, d).where("change_pct is not null").groupBy(F.substring("symbol", 1, 5).alias("curve_id"), "date").agg(F.avg("change_pct").alias("ret"))
    return R.gain_days(c)


@query("u01_union_windows", "source date:d n", "bars", "", "select 'back' as source, date, count(*) as n from bars where date <= date '1996-01-01' group by date union all select 'ahead', date, count(*) from bars where date >= date '2001-01-01' group by date")
def _(spark, d):
    b = P.bars(spark, d)
    x = b.where("date <= date'1996-01-01'").select(F.lit("back").alias("source"), "date").unionByName(b.where("date >= date'2001-01-01'").select(F.lit("ahead").alias("source"), "date"))
    return x.groupBy("source", "date").agg(F.count(F.lit(1)).alias("n"))


@query("u02_union_keep_last", "symbol date:d volume", "bars", "x as (select symbol, date, volume, 1 as o from bars union all select symbol, date, volume * 2, 2 from bars where month(date) = 2)", "select symbol, date, volume from x qualify row_number() over (partition by symbol, date order by o desc) = 1")
def _(spark, d):
    b = P.bars(spark, d).select("symbol", "date", "volume")
    x = b.withColumn("o", F.lit(1)).unionByName(b.where("month(date) = 2").withColumn("volume", F.col("volume") * 2).withColumn("o", F.lit(2)))
    return x.groupBy("symbol", "date").agg(F.max_by("volume", "o").alias("volume"))


@query("u03_set_difference", "symbol", "ebars", "", "(select symbol from ebars where date < date '2024-01-10' except select symbol from ebars where volume > 5) union (select symbol from ebars where volume > 6 intersect select symbol from ebars where date > date '2024-01-25')")
def _(spark, d):
    s = P.events_bars(spark, d)
    a = s.where("date < date'2024-01-10'").select("symbol").subtract(s.where("volume > 5").select("symbol"))
    return a.union(s.where("volume > 6").select("symbol").intersect(s.where("date > date'2024-01-25'").select("symbol"))).distinct()


@query("u04_rank_agreement", "date:d jaccard:8 common rank_corr:8", "bars", """a as (select date, symbol, row_number() over (partition by date order by turnover desc, symbol) as ra from bars), b as (select date, symbol, row_number() over (partition by date order by amount desc, symbol) as rb from bars),
j as (select coalesce(a.date, b.date) as date, ra, rb from (select * from a where ra <= 30) a full outer join (select * from b where rb <= 30) b on a.date = b.date and a.symbol = b.symbol),
k as (select *, case when ra is not null and rb is not null then row_number() over (partition by date, ra is not null and rb is not null order by ra) - row_number() over (partition by date, ra is not null and rb is not null order by rb) end as d from j),
m as (select date, count(d) as common, count(*) as n, sum(d * d) as dd from k group by date)""",
    "select date, common / n::double as jaccard, common, case when common > 1 then 1 - 6 * dd / (common * (common * common - 1))::double end as rank_corr from m")
def _(spark, d):
    b = P.bars(spark, d)
    return R.rank_agreement(R.top_n(b, "turnover", 30, "date"), R.top_n(b, "amount", 30, "date"), 30)


@query("w45_flow_rank", "date:d symbol rank", "bars", "", "select date, symbol, cast(row_number() over (partition by date order by amount * change_pct desc nulls last, symbol) as integer) as rank from bars")
def _(spark, d):
    return R.top_n(P.bars(spark, d).withColumn("net", F.col("amount") * F.col("change_pct")), "net", 10**9, "date")


@query("f02_governance_score", "symbol period:d score:6", "fin", "", """select symbol, period, least(greatest(0.45e0 * least(greatest(roe / 15, 0), 1) + 0.25e0 * least(greatest((0.8e0 - liability_ratio) / 0.8e0, 0), 1) + 0.2e0 * case when profit >= 2e5 then 0.5 + 0.5 * least(greatest((profit / 1e5) / 50, 0), 1) else 0.5 * least(greatest(1 + (profit / 1e5 - 4) / 50, 0), 1) end
    + 0.1e0 * case when ocf_ps > 0 then 1 else 0 end, 0), 1) * case when bvps > 520 then 0.7e0 else 1 end as score from fin""")
def _(spark, d):
    y = F.col("profit") / 1e5
    yoy = F.when(F.col("profit") >= 2e5, 0.5 + 0.5 * S.clip(y / 50, 0, 1)).otherwise(0.5 * S.clip(1 + (y - 4) / 50, 0, 1))
    s = 0.45 * S.clip(F.col("roe") / 15, 0, 1) + 0.25 * S.clip((0.8 - F.col("liability_ratio")) / 0.8, 0, 1) + 0.2 * yoy + 0.1 * F.when(F.col("ocf_ps") > 0, 1.0).otherwise(0.0)
    return P.financials(spark, d).select("symbol", "period", (S.clip(s, 0, 1) * F.when(F.col("bvps") > 520, 0.7).otherwise(1.0)).alias("score"))


@query("f03_liquidity_share", "symbol date:d share:8", "bars", "", "select symbol, date, amount / max(amount) over (partition by date) as share from bars")
def _(spark, d):
    return P.bars(spark, d).select("symbol", "date", (F.col("amount") / F.max("amount").over(W.Window.partitionBy("date"))).alias("share"))


@query("f07_numbers_with_units", "l_orderkey l_linenumber v:4", "", "", "select l_orderkey, l_linenumber, sum(case when l_linenumber % 4 = 3 then null else l_quantity / 100 * case l_linenumber % 4 when 0 then 1e8 when 1 then 1e4 else 1 end end) as v from lineitem group by 1, 2")
def _(spark, d):
    n, q = F.col("l_linenumber") % 4, (F.col("l_quantity") / 100).cast("string")
    text = F.when(n == 3, F.lit("-")).otherwise(F.concat(q, F.when(n == 0, F.lit("亿")).when(n == 1, F.lit("万")).otherwise(F.lit(""))))
    return P.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.number_with_unit(text).alias("v")).groupBy("l_orderkey", "l_linenumber").agg(F.sum("v").alias("v"))


@query("f08_dates", "o_orderkey a:d b:d", "", "", "select o_orderkey, o_orderdate as a, o_orderdate as b from orders")
def _(spark, d):
    o = P.read(spark, d, "orders")
    return o.select("o_orderkey", S.norm_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("a"), S.norm_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("b"))


@query("f13_impact", "order_id fill_id n rate:9 risk:8", "bars fills", ADV + ", x as (select order_id, fill_id, vol, least(greatest(case when adv > 1e-9 then qty * fill_price / adv else 1 end, 0), 1) as p from fills join adv using (symbol))",
    "select order_id, fill_id, count(*) as n, sum(least(greatest(0.1e0 * p + 0.5e0 * p * vol, 1e-4), 0.02)) as rate, sum(vol * sqrt(1 / 252.0e0)) as risk from x group by 1, 2")
def _(spark, d):
    x = P.fills(spark, d).join(R.adv_vol(P.bars(spark, d)), "symbol")
    x = x.select("order_id", "fill_id", S.impact_rate(F.col("qty") * F.col("fill_price"), F.col("adv"), F.col("vol")).alias("rate"), S.execution_risk(F.col("vol")).alias("risk"))
    return x.groupBy("order_id", "fill_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rate").alias("rate"), F.sum("risk").alias("risk"))


@query("f14_fees", "symbol side fee:4", "fills", "", "select symbol, side, sum(greatest(qty * fill_price * 0.00025e0, 5) + case side when 'sell' then qty * fill_price * 0.0005e0 else 0 end + qty * fill_price * 0.00001e0) as fee from fills group by 1, 2")
def _(spark, d):
    return P.fills(spark, d).groupBy("symbol", "side").agg(F.sum(S.fees(F.col("qty") * F.col("fill_price"), F.col("side"))).alias("fee"))


@query("f15_cost_scenarios", "scenario side cost:3 delta_bps:6", "fills", "s(scenario, slip, fee) as (values ('base', 1.0e0, 1.0e0), ('stress', 2.0e0, 1.2e0), ('calm', 0.7e0, 1.0e0)), b as (select side, sum(qty * fill_price) as v, sum(qty * fill_price * tax / 100) as c from fills group by side)",
    "select scenario, side, c * (0.6e0 * slip + 0.4e0 * fee) as cost, (c * (0.6e0 * slip + 0.4e0 * fee) - c) / v * 10000 as delta_bps from b cross join s")
def _(spark, d):
    base = P.fills(spark, d).groupBy("side").agg(F.sum(F.col("qty") * F.col("fill_price")).alias("v"), F.sum(F.col("qty") * F.col("fill_price") * F.col("tax") / 100).alias("c"))
    s = spark.createDataFrame([("base", 1.0, 1.0), ("stress", 2.0, 1.2), ("calm", 0.7, 1.0)], "scenario string, slip double, fee double")
    cost = F.col("c") * (0.6 * F.col("slip") + 0.4 * F.col("fee"))
    return base.crossJoin(F.broadcast(s)).select("scenario", "side", cost.alias("cost"), ((cost - F.col("c")) / F.col("v") * 10000).alias("delta_bps"))


@query("f16_content_id", "symbol id", "dim", "", "select symbol, sha256('{\"industry\":' || industry || ',\"market\":\"' || market || '\",\"symbol\":\"' || symbol || '\"}') as id from dim")
def _(spark, d):
    return P.dimension(spark, d).select("symbol", F.sha2(F.to_json(F.struct("industry", "market", "symbol")).cast("binary"), 256).alias("id"))


@query("f17_row_digest", "rows digest_sum digest_xor", "dim", "h as (select ('0x' || substr(md5('{\"industry\":' || industry || ',\"market\":\"' || market || '\",\"symbol\":\"' || symbol || '\"}'), 1, 12))::bigint as h from dim)", "select count(*) as rows, cast(sum(h) as bigint) as digest_sum, bit_xor(h) as digest_xor from h")
def _(spark, d):
    return R.row_digest(P.dimension(spark, d), ["industry", "market", "symbol"])


@query("f19_first_level_tag", "first n", "", "", "select split_part(p_type || '-' || p_brand, '-', 1) as first, count(*) as n from part group by 1")
def _(spark, d):
    return P.read(spark, d, "part").groupBy(F.element_at(F.split(F.concat_ws("-", "p_type", "p_brand"), "-"), 1).alias("first")).agg(F.count(F.lit(1)).alias("n"))


@query("f20_volume_estimates", "symbol vol:7 adv:4", "bars", "x as (select *, ln(close / lag(close) over (partition by symbol order by date)) as r from bars)", "select symbol, coalesce(stddev_samp(r), 0.025) as vol, coalesce(avg(amount), 1e6) as adv from x group by symbol")
def _(spark, d):
    x = P.bars(spark, d).withColumn("r", F.log(F.col("close") / F.lag("close").over(W.sym())))
    return x.groupBy("symbol").agg(F.coalesce(F.stddev_samp("r"), F.lit(0.025)).alias("vol"), F.coalesce(F.avg("amount"), F.lit(1e6)).alias("adv"))


@query("z06_failure_streaks", "user_id failures", "", "g as (select user_id, event_type = 'error' as f, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as g from events)",
    "select user_id, cast(sum(case when f and g = m then 1 else 0 end) as bigint) as failures from (select *, max(g) over (partition by user_id) as m from g) group by user_id")
def _(spark, d):
    return R.streaks(P.read(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error")
