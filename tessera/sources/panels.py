"""Panels built from the driver tables: daily or monthly bars, reports, dimensions, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol(c: Column) -> Column:
    return F.lpad(c.cast("string"), 6, "0")


def bars(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """Monthly bars by supplier: one aggregation, partial before the shuffle, and one window for the change.

    ``since``, the first day of a month, leaves older rows unread; the first month then has no change."""
    raw = read(spark, sf_dir, "lineitem")
    li = (raw.where(F.col("l_shipdate") >= F.lit(since).cast(dict(raw.dtypes)["l_shipdate"])) if since is not None else raw).select(
        symbol(F.col("l_suppkey")).alias("symbol"),
        F.trunc("l_shipdate", "month").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        "l_extendedprice",
    )
    out = li.groupBy("symbol", "date").agg(
        ((F.min("price") + F.max("price")) / 2).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.avg("price").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    return out.select("*", ((F.col("close") / prev - 1) * 100).alias("change_pct"), (F.col("volume") / 97).alias("turnover"))


BARS = """li as (select lpad(cast(l_suppkey as varchar), 6, '0') as symbol, cast(date_trunc('month', l_shipdate) as date) as date,
    l_extendedprice / l_quantity as price, l_quantity, l_extendedprice from lineitem),
bars0 as (select symbol, date, (min(price) + max(price)) / 2 as open, max(price) as high, min(price) as low,
    avg(price) as close, sum(l_quantity) as volume, round(sum(l_extendedprice), 2) as amount from li group by symbol, date),
bars as (select *, (close / lag(close) over (partition by symbol order by date) - 1) * 100 as change_pct, volume / 97 as turnover from bars0)"""


def events_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by user from the event stream; first and last by (ts, event_id)."""
    e = read(spark, sf_dir, "events").select(symbol(F.col("user_id")).alias("symbol"), F.to_date("ts").alias("date"), "ts", "event_id", "value")
    k = F.struct("ts", "event_id")
    return e.groupBy("symbol", "date").agg(
        F.min_by("value", k).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", k).alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.round(F.sum("value"), 2).alias("amount"),
    )


EVENTS_BARS = """ebars as (select lpad(cast(user_id as varchar), 6, '0') as symbol, cast(ts as date) as date, first(value order by ts, event_id) as open, max(value) as high,
    min(value) as low, last(value order by ts, event_id) as close, count(*) as volume, round(sum(value), 2) as amount from events group by 1, 2)"""


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly reports by supplier; ``period`` is the quarter's last day."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(symbol(F.col("l_suppkey")).alias("symbol"), F.date_sub(F.add_months(F.trunc("l_shipdate", "quarter"), 3), 1).alias("period")).agg(
        (F.avg("l_discount") * 200).alias("roe"),
        (F.avg("l_tax") * 10).alias("liability_ratio"),
        (F.avg("l_quantity") * 20).alias("bvps"),
        (F.avg(F.col("l_discount") - F.col("l_tax")) * 100).alias("ocf_ps"),
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("profit"),
    )


FINANCIALS = """fin as (select lpad(cast(l_suppkey as varchar), 6, '0') as symbol, cast(date_trunc('quarter', l_shipdate) + interval 3 month - interval 1 day as date) as period,
    avg(l_discount) * 200 as roe, avg(l_tax) * 10 as liability_ratio, avg(l_quantity) * 20 as bvps,
    avg(l_discount - l_tax) * 100 as ocf_ps, round(sum(l_extendedprice), 2) as revenue, round(sum(l_extendedprice * l_discount), 2) as profit
    from lineitem group by 1, 2)"""


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each symbol: industry, name, market, listing date (some unknown), float shares, special-treatment flag (some unknown)."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        symbol(k).alias("symbol"),
        F.col("s_nationkey").alias("industry"),
        F.when(k % 17 == 0, F.lit("*ST ")).otherwise(F.lit("")).alias("mark"),
        F.when(k % 3 == 0, F.lit("SH")).otherwise(F.lit("SZ")).alias("market"),
        F.when(k % 11 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (k % 1500).cast("int"))).alias("list_date"),
        F.round(F.abs("s_acctbal") + 1000, 2).alias("float_shares"),
        F.when(k % 7 != 0, k % 13 == 0).alias("is_st"),
        (k % 5 != 0).alias("is_active"),
    )


DIMENSION = """dim as (select lpad(cast(s_suppkey as varchar), 6, '0') as symbol, s_nationkey as industry, case when s_suppkey % 17 = 0 then '*ST ' else '' end as mark,
    case when s_suppkey % 3 = 0 then 'SH' else 'SZ' end as market, case when s_suppkey % 11 != 0 then date '1995-01-01' + cast(s_suppkey % 1500 as integer) end as list_date,
    round(abs(s_acctbal) + 1000, 2) as float_shares, case when s_suppkey % 7 != 0 then s_suppkey % 13 = 0 end as is_st, s_suppkey % 5 != 0 as is_active from supplier)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from line items: side by the return flag, arrival price from the undiscounted price."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("fill_id"),
        symbol(F.col("l_suppkey")).alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_returnflag") == "R", F.lit("sell")).otherwise(F.lit("buy")).alias("side"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("decision_price"),
        (F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_discount") / 10)).alias("fill_price"),
        F.col("l_tax").alias("tax"),
    )


FILLS = """fills as (select l_orderkey as order_id, l_linenumber as fill_id, lpad(cast(l_suppkey as varchar), 6, '0') as symbol, cast(l_shipdate as date) as date,
    case when l_returnflag = 'R' then 'sell' else 'buy' end as side, l_quantity as qty, l_extendedprice / l_quantity as decision_price,
    l_extendedprice / l_quantity * (1 + l_discount / 10) as fill_price, l_tax as tax from lineitem)"""


def calendar(panel: DataFrame, date_col: str = "date") -> DataFrame:
    """Distinct sessions with their index from 0 and the session before; a row for each day, so one task may sort it."""
    w = Window.orderBy(date_col)
    return panel.select(date_col).distinct().select(date_col, (F.row_number().over(w) - 1).alias("idx"), F.lag(date_col).over(w).alias("previous"))
