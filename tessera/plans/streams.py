"""Streaming operators run over the events file, to the end; SQL gives the batch twin of each.

Queries of keyed state, sinks and marks see the events arrive late and out of order, in several micro-batches: a tenth comes
three days late, another tenth one day."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.plans.statistics import gate_sql
from tessera.sources.scratch import shared_folder
from tessera.streaming import ops
from tessera.streaming.state import watch

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark, d):
    return ops.event_stream(spark, d, "events.parquet", SCHEMA)


#: How late an event arrives, in days, and the micro-batch of so many days that it falls into, for Spark and for SQL.
LATE = "case event_id % 10 when 0 then 3 when 1 then 1 else 0 end"
CLOSING, DELAY = "2024-03-01 00:00:00", "4 days"


def slice_of(width: int) -> str:
    return f"cast(floor((day(ts) - 1 + {LATE}) / {width}.0) as int)"


def arriving(spark, d, width, twice=False):
    """The events in micro-batches of their arrival; ``twice`` sends a seventh of them again in the batch that follows."""
    events, folder = spark.read.schema(SCHEMA).parquet(f"{d}/events.parquet"), f"{shared_folder(spark)}/arrivals"
    events = events.withColumn("batch", F.expr(slice_of(width)))
    if twice:
        events = events.unionByName(events.where("event_id % 7 = 0").withColumn("batch", F.col("batch") + 1))
    ops.replay(events, F.col("batch"), -(-33 // width) + twice, folder, CLOSING)
    return ops.event_stream(spark, folder, "*.parquet", SCHEMA, files=1)


def table(spark, df, mode="append"):
    at = shared_folder(spark)
    return ops.run_to_table(df, f"{at}/out", f"{at}/checkpoint", mode)


@query("z01_frozen_first", "day:d user_id event_id value:4", "", "", "select cast(ts as date) as day, user_id, arg_min(event_id, struct_pack(a := ts, b := event_id)) as event_id, arg_min(value, struct_pack(a := ts, b := event_id)) as value from events where strftime(ts, '%H:%M:%S') between '09:00:00' and '11:59:59' group by 1, 2")
def _(spark, d):
    return ops.latest_batch(table(spark, ops.freeze_first(stream(spark, d), "user_id", "09:00:00", "11:59:59"), "update"), ["day", "user_id"])


@query("z02_late_arrivals", "arrival n digest", "", "a as (select case when strftime(ts, '%H:%M:%S') between '09:25:00' and '09:25:59' then 'on_time' when strftime(ts, '%H:%M:%S') > '09:25:59' and strftime(ts, '%H:%M:%S') <= '15:00:00' then 'late' else 'out_of_window' end as arrival, sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}') as h from events)", "select arrival, count(*) as n, max(h) as digest from a group by arrival")
def _(spark, d):
    x = table(spark, ops.archive_late(stream(spark, d), ["event_id", "event_type"]))
    return x.groupBy("arrival").agg(F.count(F.lit(1)).alias("n"), F.max("payload_hash").alias("digest"))


@query("z03_staleness", "user_id n status", "", "s as (select user_id, count(*) as n, epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(max(ts))) as age from events group by 1)", "select user_id, n, case when age > 86400 then 'stalled' when age > 21600 then 'feed_stale' else 'OK' end as status from s")
def _(spark, d):
    seen = ops.latest_batch(table(spark, ops.last_seen(stream(spark, d), "user_id"), "update"), ["user_id"])
    return ops.staleness(seen, "2024-01-31 00:00:00", 21600, 86400)


@query("z04_distinct_rows", "user_id n", "", "", "select user_id, count(distinct event_id) as n from events group by user_id")
def _(spark, d):
    s = stream(spark, d)
    return table(spark, ops.distinct_rows(s.union(s), ["event_id"], delay="60 days")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("z02_late_sinks", "sink n frozen_ids late_ids digest", "", f"""a as (select *, cast(ts as date) as day, {slice_of(4)} as batch, case when strftime(ts, '%H:%M:%S') between '09:00:00' and '11:59:59' then 'on_time'
    when strftime(ts, '%H:%M:%S') > '11:59:59' and strftime(ts, '%H:%M:%S') <= '15:00:00' then 'late' else 'out_of_window' end as arrival from events),
f as (select *, case when arrival = 'on_time' then row_number() over (partition by day, user_id, arrival order by batch, ts, event_id) end as k from a),
s as (select case when k = 1 then 'frozen' when k > 1 then 'late' else arrival end as sink, event_id, user_id, event_type, ts from f)""",
    "select sink, count(*) as n, cast(coalesce(sum(event_id) filter (sink = 'frozen'), 0) as bigint) as frozen_ids, cast(coalesce(sum(event_id) filter (sink = 'late'), 0) as bigint) as late_ids, max(sha256(event_id || ':' || user_id || ':' || event_type)) as digest from s group by sink")
def _(spark, d):
    at = shared_folder(spark)
    x = arriving(spark, d, 4).where("event_id is not null")
    ops.run_batches(x, ops.into_sinks(f"{at}/sinks", "user_id", "ts", "event_id", "09:00:00", "11:59:59", "15:00:00"), f"{at}/checkpoint")
    of = lambda sink: F.coalesce(F.sum(F.when(F.col("sink") == sink, F.col("event_id"))), F.lit(0)).alias(f"{sink}_ids")
    read = [spark.read.parquet(f"{at}/sinks/{sink}").select(F.lit(sink).alias("sink"), "event_id", "user_id", "event_type") for sink in ops.SINKS]
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("sink").agg(F.count(F.lit(1)).alias("n"), of("frozen"), of("late"), F.max(F.sha2(F.concat_ws(":", "event_id", "user_id", "event_type").cast("binary"), 256)).alias("digest"))


@query("z03_silent_keys", "user_id last_ms at_ms status", "", f"""e as (select user_id, epoch_us(ts) // 1000 as ms, lead(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) as next_ms from events),
g as (select user_id, ms, next_ms, coalesce(next_ms, epoch_ms(timestamp '{CLOSING}' - interval {DELAY})) - ms as gap from e)""",
    """select user_id, ms as last_ms, ms + 21600000 as at_ms, 'feed_stale' as status from g where gap > 21600000
union all select user_id, ms, ms + 86400000, 'stalled' from g where gap > 86400000
union all select user_id, ms, next_ms, 'OK' from g where next_ms is not null and gap > 21600000""")
def _(spark, d):
    return table(spark, watch(arriving(spark, d, 11).withWatermark("ts", DELAY), "user_id", ["ts", "event_id"], 21600, 86400))


@query("z04_append_above_mark", "user_id n first_id last_id ids", "", f"""a as (select event_id, user_id, ts, {slice_of(4)} as batch from events),
b as (select * from a union all select event_id, user_id, ts, batch + 1 from a where event_id % 7 = 0),
m as (select *, max(ts) over (partition by user_id order by batch range between unbounded preceding and 1 preceding) as mark from b),
k as (select distinct user_id, event_id, ts from m where mark is null or ts > mark)""",
    "select user_id, count(*) as n, arg_min(event_id, struct_pack(a := ts, b := event_id)) as first_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) as last_id, cast(sum(event_id) as bigint) as ids from k group by user_id")
def _(spark, d):
    at = shared_folder(spark)
    x = arriving(spark, d, 4, twice=True).where("event_id is not null")
    ops.run_batches(x, ops.append_above_mark(f"{at}/table", "user_id", "ts", ["event_id"]), f"{at}/checkpoint")
    o = F.struct("ts", "event_id")
    return spark.read.parquet(f"{at}/table/rows").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", o).alias("first_id"), F.max_by("event_id", o).alias("last_id"), F.sum("event_id").alias("ids"))


@query("z05_held_values", "id value:4 source", "", "x as (select event_id as id, user_id, ts, case when event_type != 'error' then value end as v from events), y as (select *, last_value(v ignore nulls) over (partition by user_id order by ts, id rows unbounded preceding) as h from x)", "select id, h as value, case when v is not null then 'live' when h is null then 'missing' else 'held' end as source from y")
def _(spark, d):
    s = arriving(spark, d, 11).withWatermark("ts", DELAY).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return table(spark, ops.hold_last(s, "user_id", ["ts", "event_id", "v"]))


@query("z06_streaming_streaks", "id failures", "", "g as (select event_id as id, user_id, ts, event_type = 'error' as f, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from events)", "select id, cast(sum(case when f then 1 else 0 end) over (partition by user_id, g order by ts, id rows unbounded preceding) as bigint) as failures from g")
def _(spark, d):
    return table(spark, ops.failure_streak(arriving(spark, d, 11).withWatermark("ts", DELAY), "user_id", ["ts", "event_id", "event_type"], "error"))


@query("z07_streaming_gate", "user_id id raw regime", "", "ev as (select user_id, event_id as id, ts, case when value > 60 then 'risk' when value > 30 then 'caution' else 'normal' end as raw from events),\n" + gate_sql("ev", "user_id", "2", "2", "ts, id"),
    "select user_id, id, raw, regime from gate")
def _(spark, d):
    raw = F.when(F.col("value") > 60, F.lit("risk")).when(F.col("value") > 30, F.lit("caution")).otherwise(F.lit("normal"))
    return table(spark, ops.gate(arriving(spark, d, 11).withWatermark("ts", DELAY).withColumn("raw", raw), "user_id", ["ts", "event_id", "raw"], 2, 2))


@query("z08_alerts", "level n", "", "", "select case when user_id % 11 = 0 or value > 200 then 'critical' when event_id % 5 > 2 then 'error' when event_id % 5 > 0 or event_type = 'error' then 'warning' else 'ok' end as level, count(*) as n from events group by 1")
def _(spark, d):
    level = ops.alert(F.col("event_id") % 5, F.col("user_id") % 11, F.col("value") > 200, F.col("event_type") == "error")
    return table(spark, stream(spark, d).select("event_id", level.alias("level"))).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
