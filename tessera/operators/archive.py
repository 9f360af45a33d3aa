"""Archives of daily snapshots: block mapping, day assembly, evidence by day, matured states and validation batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ic


def drop_suspended(df: DataFrame, status: str = "tradestatus") -> tuple[DataFrame, DataFrame]:
    """(rows that trade, one row with the number dropped and some of their symbols)."""
    off = F.coalesce(F.col(status), F.lit("")) != "1"
    return df.where(~off), df.agg(F.count_if(off).alias("dropped"), F.slice(F.array_sort(F.collect_set(F.when(off, F.col("symbol")))), 1, 5).alias("sample"))


def append_new_days(have: DataFrame, snap: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """History with the snapshot's rows whose keys it lacks; forced, the snapshot's keys are replaced."""
    if force:
        return have.join(snap.select(*keys).distinct(), keys, "left_anti").unionByName(snap)
    return have.unionByName(snap.join(have.select(*keys).distinct(), keys, "left_anti"))


def map_blocks(rows: DataFrame, blocks: dict[str, str], above, name: str = "block", date: str = "date") -> DataFrame:
    """Codes of named blocks by a literal map, only rows later than ``above`` and with a known block."""
    m = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    return rows.withColumn("code", F.element_at(m, F.col(name))).where(F.col("code").isNotNull() & (F.col(date) > F.lit(above)))


def assemble_days(days: DataFrame, parts: dict[str, DataFrame], date: str = "date") -> DataFrame:
    """Each day with the rows of each part and a status: complete, partial or missing."""
    out = days.select(date).distinct()
    for name, df in parts.items():
        out = out.join(df.groupBy(date).agg(F.count(F.lit(1)).alias(name)), date, "left")
    have = sum(((F.coalesce(F.col(n), F.lit(0)) > 0).cast("int") for n in parts), F.lit(0))
    return out.select(date, *[F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in parts], F.when(have == len(parts), F.lit("complete")).when(have == 0, F.lit("missing")).otherwise(F.lit("partial")).alias("status"))


def monthly_eval(panel: DataFrame, factor: str, label: str, least: int = 30) -> DataFrame:
    """Monthly rank IC on a label winsorised at 1 and 99 %, with coverage."""
    from tessera.functions.scalar import winsorize

    x = panel.select("date", F.col(factor).alias("value"), winsorize(label, "date").alias("label"))
    cover = x.groupBy("date").agg((F.count("value") / F.count(F.lit(1))).alias("coverage"))
    return ic.rank_ic(x, ["date"], least=least).join(cover, "date").select("date", "n", "ic", "coverage")


def matured_state(snapshots: DataFrame, labels: DataFrame, cutoff: Column, horizon_days: int) -> DataFrame:
    """IC of stored snapshots by (day, factor), only of days whose labels have matured by the cut-off."""
    x = snapshots.where(F.date_add("date", horizon_days) <= cutoff).join(labels, ["date", "symbol"])
    return ic.rank_ic(x, ["date", "factor"], least=5)


def rectangular_blocks(runs: DataFrame, least: int = 3, least_days: int = 10) -> DataFrame:
    """Windows where every configuration has enough rows, on the days they share; an odd number of windows loses the earliest."""
    n = runs.select("config").distinct().count()
    by = runs.groupBy("window", "config").agg(F.count("ret").alias("rows")).where(F.col("rows") >= least)
    full = by.groupBy("window").agg(F.count(F.lit(1)).alias("configs")).where(F.col("configs") == n).select("window")
    x = runs.where("ret is not null").join(full, "window", "left_semi")
    w = Window.partitionBy("window", "date")
    x = x.withColumn("__c", F.count(F.lit(1)).over(w)).where(F.col("__c") == n).drop("__c")
    days = x.groupBy("window").agg(F.countDistinct("date").alias("days")).where(F.col("days") >= least_days)
    # a row for each window
    kept = days.withColumn("__k", F.row_number().over(Window.orderBy(F.desc("window")))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    kept = kept.where(F.col("__k") <= F.col("__n") - F.col("__n") % 2).select("window")
    return x.join(kept, "window", "left_semi")


def recent_samples(perf: DataFrame, trades: DataFrame, days: int) -> DataFrame:
    """Trades of the last days with the performance of their day."""
    last = perf.select("date").distinct().orderBy(F.desc("date")).limit(days)
    return trades.join(F.broadcast(last), "date").join(perf, "date")
