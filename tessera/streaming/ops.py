"""Operators over streams of (key, ts, value): freezing, late data, staleness, de-duplication, held values, streaks, gates.

A watermark bounds what windows, de-duplication and keyed state remember.  Operators that depend on order take each key's rows
by event time (``tessera.streaming.state``), whatever the micro-batches.  Tables are written by batch: a batch's rows stand in
a folder of its number, which a replay of the batch writes again, so a restart adds nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.statistics import GATE_START, confirm
from tessera.sources.stores import exists
from tessera.streaming.state import in_order

#: Bytes of a row group in replayed files.
ROW_GROUP = 4 << 20

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, name: str, schema: str, ts: str = "ts", files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of one name in a folder, at most ``files`` in a micro-batch; zoneless times become UTC
    instants, as watermarks need them."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", True)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    df = reader.parquet(folder)
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def replay(df: DataFrame, slices: Column, n: int, folder: str, closing: str | None, ts: str = "ts") -> None:
    """Writes a table as files in the order of its arrival, one for each of the ``n`` values of ``slices``; the last also has a
    row of nothing but the time ``closing``, which moves a watermark past all others.

    The table is read once and written by slices in parallel; then each slice becomes one file, of short row groups, so that its
    micro-batch reads it in several tasks."""
    spark, dealt = df.sparkSession, f"{folder}-dealt"
    df.withColumn("__slice", slices).write.partitionBy("__slice").parquet(dealt)
    x = spark.read.schema(", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, ("__slice", "int")])).parquet(dealt)
    for i in range(n):
        part = x.where(F.col("__slice") == i).drop("__slice").coalesce(1)
        if closing and i == n - 1:
            end = spark.range(1).select(*[(F.lit(closing) if c == ts else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])
            part = part.unionByName(end).coalesce(1)
        part.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(folder)


def run(spark: SparkSession, writer) -> None:
    """Runs a stream's writer over all that is there, with its state in RocksDB."""
    conf = spark.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before) if before else conf.unset(name)


def put_batch(df: DataFrame, path: str, batch: int) -> None:
    """A batch's rows in a folder of their own, in place of what an earlier attempt at the batch left there."""
    df.write.mode("overwrite").parquet(f"{path}/__batch={batch}")


def batches_before(spark: SparkSession, path: str, batch: int, schema) -> DataFrame:
    """The rows that earlier batches wrote; none if there is no table yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("__batch") < batch)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns the table it wrote; updates of a key keep the latest batch's row."""
    if mode == "append":
        run(stream.sparkSession, stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path))
    else:
        run(stream.sparkSession, stream.writeStream.outputMode(mode).foreachBatch(lambda df, batch: put_batch(df, path, batch)).option("checkpointLocation", checkpoint))
    return stream.sparkSession.read.parquet(path)


def latest_batch(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from the last batch that updated it."""
    rest = [c for c in df.columns if c not in (*keys, "__batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__r")).select(*keys, "__r.*")


def freeze_first(stream: DataFrame, key: str, start: str, end: str, ts: str = "ts", tie: str = "event_id", delay: str = "1 day") -> DataFrame:
    """The first row of each key and day whose time of day is inside [start, end]; later rows change nothing."""
    clock = F.date_format(ts, "HH:mm:ss")
    x = stream.where(clock.between(start, end)).withWatermark(ts, delay)
    return x.groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.min_by(F.struct(ts, tie, "value"), F.struct(ts, tie)).alias("first")).select(F.col("w.start").cast("date").alias("day"), key, F.col(f"first.{tie}").alias(tie), F.col("first.value").alias("value"))


def arrival_class(ts: Column, start: str = "09:25:00", end: str = "09:25:59", close: str = "15:00:00") -> Column:
    """on_time inside the freezing window, late up to the close, else out_of_window."""
    clock = F.date_format(ts, "HH:mm:ss")
    return F.when(clock.between(start, end), F.lit("on_time")).when((clock > end) & (clock <= close), F.lit("late")).otherwise(F.lit("out_of_window"))


def archive_late(stream: DataFrame, payload: list[str], ts: str = "ts") -> DataFrame:
    """Each row with its class and the hash of its payload."""
    return stream.withColumn("arrival", arrival_class(F.col(ts))).withColumn("payload_hash", F.sha2(F.to_json(F.struct(*payload)).cast("binary"), 256))


def last_seen(stream: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Latest time of each key, as updates."""
    return stream.groupBy(key).agg(F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def staleness(seen: DataFrame, now: str, stale_s: int, stalled_s: int) -> DataFrame:
    """OK, feed_stale or stalled by the age of each key's last row."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_ts")
    return seen.withColumn("age_s", age).withColumn("status", F.when(age > stalled_s, F.lit("stalled")).when(age > stale_s, F.lit("feed_stale")).otherwise(F.lit("OK")))


def distinct_rows(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def append_above_mark(path: str, key: str, ts: str, ids: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer: rows later than their key's last in the table, each ``ids`` once.

    Marks are read once, when the batch begins, from the last snapshot of an earlier batch, a row for each key; the rows and then the
    new marks are written under the batch's number, so an attempt that failed between the two is written over."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        marks_schema = f"{key} {dict(df.dtypes)[key]}, __mark {dict(df.dtypes)[ts]}, __batch int"
        known = batches_before(spark, f"{path}/marks", batch, marks_schema)
        last = known.agg(F.max("__batch")).first()[0] if batch else None
        marks = known.where(F.col("__batch") == last).drop("__batch") if last is not None else known.drop("__batch").limit(0)
        new = df.join(marks, key, "left").where(F.col("__mark").isNull() | (F.col(ts) > F.col("__mark"))).drop("__mark").dropDuplicates(ids)
        put_batch(new, f"{path}/rows", batch)
        written = spark.read.schema(df.schema).parquet(f"{path}/rows/__batch={batch}")
        both = marks.unionByName(written.groupBy(key).agg(F.max(ts).alias("__mark")))
        put_batch(both.groupBy(key).agg(F.max("__mark").alias("__mark")), f"{path}/marks", batch)

    return write


SINKS = ("frozen", "late", "out_of_window")


def into_sinks(path: str, key: str, ts: str, tie: str, start: str, end: str, close: str) -> Callable[[DataFrame, int], None]:
    """A batch writer with three tables: ``frozen`` has the first row of each key and day inside [start, end], which no later batch
    changes; ``late`` archives, with the hash of their payload, rows up to the close and those inside the window that came
    after the freeze; ``out_of_window`` has the rest."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        x = df.withColumn("day", F.to_date(ts)).withColumn("arrival", arrival_class(F.col(ts), start, end, close))
        x = x.withColumn("payload_hash", F.sha2(F.to_json(F.struct(*df.columns)).cast("binary"), 256)).persist()
        days = x.where("arrival = 'on_time'").select("day").distinct()
        held = batches_before(spark, f"{path}/frozen", batch, f"day date, {key} {dict(df.dtypes)[key]}, __batch int").join(F.broadcast(days), "day", "left_semi").select("day", key).distinct()
        first = F.row_number().over(Window.partitionBy("day", key).orderBy(ts, tie)) == 1
        inside = x.where("arrival = 'on_time'").withColumn("__first", first).join(held.withColumn("__held", F.lit(True)), ["day", key], "left")
        new = F.col("__first") & F.col("__held").isNull()
        put_batch(inside.where(new).drop("__first", "__held"), f"{path}/frozen", batch)
        after = inside.where(~new).drop("__first", "__held")
        put_batch(x.where("arrival = 'late'").unionByName(after), f"{path}/late", batch)
        put_batch(x.where("arrival = 'out_of_window'"), f"{path}/out_of_window", batch)
        x.unpersist()

    return write


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that is there through a batch writer."""
    run(stream.sparkSession, stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def hold_last(stream: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, id, value, source): a missing value is the last known one, labelled ``held``, or ``missing`` if there is none.

    ``cols`` are the time, under a watermark, an id that breaks ties, and the value."""

    def step(state, row):
        _, i, v = row
        if v is not None:
            return (v,), [(i, v, "live")]
        return state, [(i, state[0], "missing" if state[0] is None else "held")]

    return in_order(stream, key, cols, "id long, value double, source string", "last double", (None,), step)


def failure_streak(stream: DataFrame, key: str, cols: list[str], failed: str) -> DataFrame:
    """(key, id, failures) after each row: failures since the last success."""

    def step(state, row):
        n = state[0] + 1 if row[2] == failed else 0
        return (n,), [(row[1], n)]

    return in_order(stream, key, cols, "id long, failures long", "failures long", (0,), step)


def gate(stream: DataFrame, key: str, cols: list[str], enter: int = 3, leave: int = 3) -> DataFrame:
    """(key, id, raw, regime): the confirmation of states, with the run at hand and what is in force kept by key."""

    def step(state, row):
        state, regime = confirm(state, row[2], enter, leave)
        return state, [(row[1], row[2], regime)]

    return in_order(stream, key, cols, "id long, raw string, regime string", "kind boolean, length long, in_force boolean", GATE_START, step)


def alert(fallback_age: Column, pool: Column, past_deadline: Column, over_budget: Column) -> Column:
    """Worst severity: empty pool or a missed deadline, an old fallback, a budget overrun, or none."""
    return F.when((pool == 0) | past_deadline, F.lit("critical")).when(fallback_age > 2, F.lit("error")).when((fallback_age > 0) | over_budget, F.lit("warning")).otherwise(F.lit("ok"))
