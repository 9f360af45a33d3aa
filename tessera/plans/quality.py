"""Queries over quality checks, coverage, ledgers and settlement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import quality as Q
from tessera.operators import windows as W
from tessera.plans.evaluation import PIT, pit_panel
from tessera.plans.registry import query
from tessera.plans.windows import FWD
from tessera.sources import panels as P
from tessera.sources import buckets, stores
from tessera.sources.scratch import shared_folder


@query("a04_table_stats", "rows last_day:d null_change_pct:8 duplicate_share:8", "bars", "", "select count(*) as rows, max(date) as last_day, 1 - count(change_pct) / count(*)::double as null_change_pct, 1 - count(distinct (symbol, date)) / count(*)::double as duplicate_share from bars")
def _(spark, d):
    return Q.table_stats(P.bars(spark, d), "date", ["symbol", "date"], ["change_pct"])


@query("a04_lineitem_duplicates", "rows duplicate_share:8", "", "", "select count(*) as rows, 1 - count(distinct (l_orderkey, l_linenumber)) / count(*)::double as duplicate_share from lineitem")
def _(spark, d):
    return Q.table_stats(P.read(spark, d, "lineitem"), "l_shipdate", ["l_orderkey", "l_linenumber"], ["l_quantity"])


@query("a05_integrity", "rows first:d last:d keys change_pct_null change_pct_negative change_pct_extreme", "bars", "", "select count(*) as rows, min(date) as first, max(date) as last, count(distinct symbol) as keys, count(*) - count(change_pct) as change_pct_null, count(*) filter (change_pct < 0) as change_pct_negative, count(*) filter (abs(change_pct) > 50) as change_pct_extreme from bars")
def _(spark, d):
    return Q.integrity(P.bars(spark, d), "date", "symbol", ["change_pct"], 50)


@query("a06_key_coverage", "common left_only right_only", "", "l as (select distinct doc_id from labels), t as (select distinct doc_id from documents where n_chars > 500)", "select count(*) filter (l.doc_id is not null and t.doc_id is not null) as common, count(*) filter (t.doc_id is null) as left_only, count(*) filter (l.doc_id is null) as right_only from l full outer join t on l.doc_id = t.doc_id")
def _(spark, d):
    return Q.key_coverage(P.read(spark, d, "labels"), P.read(spark, d, "documents").where("n_chars > 500"), ["doc_id"])


BAD = "bb as (select symbol, date, case when volume % 41 = 0 then null else open end as open, case when volume % 37 = 0 then low * 0.9 else high end as high, low, case when volume % 43 = 0 then -close else close end as close, case when volume % 47 = 0 then -1 else volume end as volume, amount from bars)"


@query("b55_validate_bars", "rows bad null_core price ohlc negative", "bars", BAD + """, e as (select open is null or high is null or low is null or close is null as a, least(open, high, low, close) <= 0 as b, high + 1e-6 < greatest(open, low, close) or low - 1e-6 > least(open, high, close) as c, volume < 0 or amount < 0 as d from bb)""",
    "select count(*) as rows, count(*) filter (a or b or c or d) as bad, count(*) filter (a) as null_core, count(*) filter (b) as price, count(*) filter (c) as ohlc, count(*) filter (d) as negative from e")
def _(spark, d):
    v = F.col("volume")
    x = P.bars(spark, d).select(
        "symbol", "date", F.when(v % 41 != 0, F.col("open")).alias("open"), F.when(v % 37 == 0, F.col("low") * 0.9).otherwise(F.col("high")).alias("high"), "low", F.when(v % 43 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(v % 47 == 0, -1).otherwise(v).alias("volume"), "amount",
    )
    return Q.validate_bars(x)


@query("s16_gaps", "date:d", "ebars", "", "select distinct date from ebars where date not in (select date from ebars where symbol = '000007')")
def _(spark, d):
    b = P.events_bars(spark, d)
    return Q.gaps(b, b.where("symbol = '000007'"))


@query("b66_coverage", "symbol days coverage:8", "ebars", "", "select symbol, count(distinct date) as days, count(distinct date) / 30.0e0 as coverage from ebars group by symbol")
def _(spark, d):
    return Q.coverage_by_symbol(P.events_bars(spark, d), 30)


@query("b56_backfill_plan", "action reason day:d", "ebars", "", "select distinct 'backfill' as action, 'both_behind' as reason, date as day from ebars where date > date '2024-01-20' and date <= date '2024-01-25'")
def _(spark, d):
    return Q.backfill_plan("2024-01-20", "2024-01-20", "2024-01-25", "official", P.events_bars(spark, d).select("date").distinct())


@query("b57_approximate_fill", "symbol date:d pb:6 cap:2 source", "bars fin dim", PIT, "select symbol, date, case when bvps > 0 then close / bvps end as pb, close * float_shares as cap, 'approx' as source from pit where right(symbol, 1) = '4'")
def _(spark, d):
    missing = P.bars(spark, d).select("symbol", "date").where("right(symbol, 1) = '4'")
    return Q.approximate_fill(missing, pit_panel(spark, d))


@query("b19_settled_labels", "symbol date:d fwd_1:6 settled", "bars", FWD + ", st as (select symbol, date, case when year(date) < 1998 then 0.5e0 end as old from bars)", "select symbol, date, coalesce(old, fwd_1) as fwd_1, coalesce(old, fwd_1) is not null as settled from st join fwd using (symbol, date)")
def _(spark, d):
    b = P.bars(spark, d)
    stored = b.select("symbol", "date", F.when(F.year("date") < 1998, 0.5).alias("fwd_1"))
    return Q.settle(stored, W.forward_returns(b, (1,)), ["symbol", "date"], ["fwd_1"]).withColumn("settled", F.col("fwd_1").isNotNull())


@query("b58_chain", "ledger rows broken first_bad", "", "", "select cast(user_id as bigint) as ledger, count(*) as rows, count(*) filter (k = 2) as broken, cast(case when count(*) filter (k = 2) > 0 then 2 end as bigint) as first_bad from (select user_id, row_number() over (partition by user_id order by event_id) as k from events where user_id % 7 = 0 union all select user_id, 0 - row_number() over (partition by user_id order by event_id) as k from events where user_id % 7 != 0) group by 1")
def _(spark, d):
    e = P.read(spark, d, "events")
    w = W.Window.partitionBy("user_id").orderBy("event_id")
    rows = e.select(F.col("user_id").alias("ledger"), F.row_number().over(w).cast("long").alias("seq"), F.concat_ws(",", F.col("event_id").cast("string"), "event_type").alias("payload"))
    chain = Q.build_chain(rows)
    # the second row of every seventh ledger is altered after it was hashed
    hurt = F.when((F.col("ledger") % 7 == 0) & (F.col("seq") == 2), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return Q.verify_chain(chain.withColumn("payload", hurt))


@query("b92_boundary_profile", "date:d source rows coverage:8 median:6", "bars", "", "select date, case when right(symbol, 1) < '5' then 'a' else 'b' end as source, count(*) as rows, count(change_pct) / count(*)::double as coverage, median(change_pct) as median from bars group by 1, 2")
def _(spark, d):
    return Q.boundary_profile(P.bars(spark, d).withColumn("source", F.when(F.expr("right(symbol, 1) < '5'"), F.lit("a")).otherwise(F.lit("b"))), "change_pct")


@query("b93_worklist", "symbol missing first:d last:d", "bars", "", "select symbol, count(*) as missing, min(date) as first, max(date) as last from (select *, case when volume % 5 != 0 then change_pct end as v from bars) where v is null group by symbol")
def _(spark, d):
    return Q.worklist(P.bars(spark, d).withColumn("v", F.when(F.col("volume") % 5 != 0, F.col("change_pct"))), "v")


@query("b94_rebuilt_day", "symbol turnover:6", "bars", "x as (select symbol, turnover from bars where date = date '1998-03-01')", "select symbol, turnover * case when right(symbol, 1) = '1' then 100 else 1 end as turnover from x")
def _(spark, d):
    x = P.bars(spark, d).where("date = date'1998-03-01'").select("symbol", "turnover")
    return Q.rebuild_day(x.where("right(symbol, 1) != '1'"), x, 5)


@query("b95_rebuilt_dimension", "code market", "dim", "", "select distinct symbol as code, case when symbol like '6%' then 'SH' when symbol like '4%' or symbol like '8%' then 'BJ' else 'SZ' end as market from dim")
def _(spark, d):
    x = P.dimension(spark, d).select(F.col("symbol").alias("code"))
    return Q.rebuild_dimension(x.union(x).union(x.select(F.concat("code", F.lit("x")))), 5)


@query("s11_above_watermark", "symbol n first:d", "ebars", "m as (select symbol, max(date) as wm from ebars where date <= date '2024-01-12' and right(symbol, 1) != '2' group by symbol)", "select e.symbol, count(*) as n, min(e.date) as first from ebars e left join m using (symbol) where wm is null or e.date > wm group by 1")
def _(spark, d):
    b = P.events_bars(spark, d)
    x = stores.above_watermark(b, b.where("date <= date'2024-01-12' and right(symbol, 1) != '2'"))
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"))


@query("s12_upsert", "symbol date:d volume", "ebars", "x as (select symbol, date, volume, 0 as o from ebars union all select symbol, date, volume * 10, 1 from ebars where right(symbol, 1) = '5')", "select symbol, date, volume from x qualify row_number() over (partition by symbol, date order by o desc) = 1")
def _(spark, d):
    b = P.events_bars(spark, d).select("symbol", "date", "volume")
    new = b.where("right(symbol, 1) = '5'").withColumn("volume", F.col("volume") * 10)
    at = shared_folder(spark)
    buckets.create(b, at, ["symbol", "date"], ["symbol"], 16)  # a symbol's days are in one bucket, so an upsert of symbols touches few
    buckets.merge(new.withColumn("__order", F.lit(1).cast("long")), at)
    return buckets.read(spark, at)


@query("s15_normalized", "symbol date:d volume amount:2", "ebars", "", "select symbol, date, volume * 100.0e0 as volume, amount * 1000.0e0 as amount from ebars qualify count(*) over (partition by date) >= 5")
def _(spark, d):
    b = P.events_bars(spark, d)
    raw = b.select(F.concat(F.regexp_replace("symbol", "^0+(?=.)", ""), F.lit(".SZ")).alias("code"), F.date_format("date", "yyyyMMdd").alias("day"), F.col("volume").cast("string").alias("vol"), F.col("amount").cast("string").alias("amt"))
    spec = {"symbol": {"from": "code", "kind": "code"}, "date": {"from": "day", "kind": "date"}, "volume": {"from": "vol", "times": 100.0}, "amount": {"from": "amt", "times": 1000.0}}
    return stores.normalize(raw, spec, ["symbol", "date"], 5)


@query("s19_recomputed_window", "day:d n", "ebars", "", "select date as day, count(*) * case when date >= date '2024-01-20' then 10 else 1 end as n from ebars group by date")
def _(spark, d):
    import datetime

    c = P.events_bars(spark, d).groupBy(F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return stores.recompute_window(c, c.withColumn("n", F.col("n") * 10), datetime.date(2024, 1, 20))


@query("s22_merged_snapshot", "symbol date:d volume", "ebars", "h as (select symbol, date, volume from ebars), s as (select symbol, max(volume) as volume from ebars group by symbol)", "select * from h union all select symbol, date '2024-01-15' as date, volume from s where symbol not in (select symbol from h where date = date '2024-01-15')")
def _(spark, d):
    import datetime

    h = P.events_bars(spark, d).select("symbol", "date", "volume")
    return stores.merge_snapshot(h, h.groupBy("symbol").agg(F.max("volume").alias("volume")), datetime.date(2024, 1, 15), ["symbol"])


@query("b59_verify_manifest", "name status", "", "", "select event_type as name, case when event_type = 'error' then 'changed' when event_type = 'view' then 'missing' else 'ok' end as status from events group by event_type union all select 'more' as name, 'extra' as status")
def _(spark, d):
    at = shared_folder(spark)
    kind = F.nullif(F.regexp_extract("path", "event_type=([^/]*)/part-", 1), F.lit(""))

    def write(df, to):
        # a file for each type, its rows in order, so that equal rows give equal files
        line = F.concat_ws(",", "event_id", F.round("value", 6).cast("string"))
        df.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", line.alias("value")).write.partitionBy("event_type").text(to)

    e = P.read(spark, d, "events").select("event_type", "event_id", "value")
    write(e, f"{at}/first")
    more = e.where("event_type = 'click'").withColumn("event_type", F.lit("more"))
    later = e.where("event_type <> 'view'").withColumn("value", F.when(F.col("event_type") == "error", F.col("value") + 1).otherwise(F.col("value")))
    write(later.unionByName(more), f"{at}/later")
    return Q.verify_manifest(spark, f"{at}/later", Q.manifest_of(spark, f"{at}/first", kind), kind)
