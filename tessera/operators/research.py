"""Multi-stage factor research: screening, monthly panels, hypotheses, decompositions, settlement and comparisons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import ic
from tessera.operators.quantiles import exact_quantiles
from tessera.sources.scratch import written


def screen(report: DataFrame, min_ic: float = 0.02, min_icir: float = 0.3, min_t: float = 2.0) -> DataFrame:
    """Gates of each factor of a report and whether it passes them all."""
    g = {"ic_ok": F.abs("ic_mean") >= min_ic, "icir_ok": F.abs("icir") >= min_icir, "t_ok": F.abs("t_value") >= min_t}
    x = report.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in g.items()})
    return x.withColumn("passed", F.col("ic_ok") & F.col("icir_ok") & F.col("t_ok"))


def fuse(long: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("date", "symbol"), day: str = "date") -> DataFrame:
    """Weighted sum of z-scores of long factors over the weights a row has, z-scored again; weights are a row for each factor."""
    z = long.where("value is not null").withColumn("z", S.cs_zscore("value", day, "factor"))
    x = z.join(F.broadcast(weights), "factor").groupBy(*keys).agg((F.sum(F.col("weight") * F.col("z")) / F.sum(F.abs("weight"))).alias("raw"))
    return x.withColumn("score", S.cs_zscore("raw", day)).drop("raw")


def evidence(long: DataFrame, segments: int = 4, least: int = 30) -> DataFrame:
    """Coverage, distinct values, deviation, full-sample rank IC and agreement of its sign over ordered segments, with reasons.

    The table is read several times, so write it first where it is costly."""
    # places over all days from the days' counts (a row for each day and factor), so that no factor is sorted in one task
    by = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = long.groupBy("factor", "date").agg(F.count(F.lit(1)).alias("__c"))
    days = days.withColumns({"__before": F.coalesce(F.sum("__c").over(by), F.lit(0)), "__n": F.sum("__c").over(Window.partitionBy("factor"))})
    low, extra = F.floor(F.col("__n") / segments), F.col("__n") % segments
    head = extra * (low + 1)
    segment = lambda i: (F.when(i < head, F.floor(i / (low + 1))).otherwise(extra + F.floor((i - head) / low)) + 1).cast("int")
    days = days.withColumns({"__seg": segment(F.col("__before")), "__last": segment(F.col("__before") + F.col("__c") - 1)}).drop("__c")
    # a day inside a segment needs no order; only the days that two segments share are sorted
    x = long.select("factor", "date", "symbol", "value", "label").join(F.broadcast(days), ["factor", "date"])
    place = F.col("__before") + F.row_number().over(Window.partitionBy("factor", "date").orderBy("symbol")) - 1
    shared = x.where(F.col("__seg") < F.col("__last")).withColumn("__i", place).withColumn("__seg", segment(F.col("__i")))
    x = x.where(F.col("__seg") == F.col("__last")).select("factor", "__seg", "value", "label").unionByName(shared.select("factor", "__seg", "value", "label"))
    base = long.groupBy("factor").agg((F.count("value") / F.count(F.lit(1))).alias("coverage"), F.countDistinct("value").alias("distinct"), F.stddev_samp("value").alias("std"))
    ics = written(ic.parted_rank_ic(x, ["factor"], "__seg", least=least))  # a row for each factor and segment
    full = ics.where("__seg = 0").select("factor", "n", "ic")
    seg = ics.where("__seg > 0").join(full.select("factor", F.col("ic").alias("all")), "factor")
    agree = seg.groupBy("factor").agg(F.avg((F.signum("ic") == F.signum("all")).cast("double")).alias("agreement"))
    out = base.join(full, "factor", "left").join(agree, "factor", "left")
    reasons = F.array(F.when(F.col("coverage") < 0.5, F.lit("coverage")), F.when(F.col("std") <= 1e-12, F.lit("constant")), F.when(F.abs("ic") < 0.01, F.lit("weak")), F.when(F.col("agreement") < 0.75, F.lit("unstable")))
    return out.withColumn("reasons", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ","))


def direction_consistency(ics: DataFrame, window: Column, reference: dict[str, int]) -> DataFrame:
    """in_env if all factor signs of a window equal the reference's, reverse if all are opposite, else mixed."""
    ref = F.lit(None).cast("int")
    for f, s in reference.items():
        ref = F.when(F.col("factor") == f, s).otherwise(ref)
    x = ics.where("ic is not null").groupBy(window.alias("window_id"), "factor").agg(F.avg("ic").alias("m"))
    same = F.signum("m") == ref
    return x.groupBy("window_id").agg(F.count(F.lit(1)).alias("factors"), F.when(F.bool_and(same), F.lit("in_env")).when(F.bool_and(~same), F.lit("reverse")).otherwise(F.lit("mixed")).alias("direction"))


def pool_against_universe(panel: DataFrame, in_pool: Column, score: str, label: str, n: int = 10) -> DataFrame:
    """Rank IC inside a pool and over all, and the share of the pool's top n that the universe's top n has."""
    x = panel.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("__in", in_pool)
    long = x.select("date", F.col(score).alias("value"), F.col(label).alias("label"), "__in")
    a = ic.rank_ic(long, ["date"], least=5).select("date", F.col("ic").alias("ic_all"))
    b = ic.rank_ic(long.where("__in"), ["date"], least=5).select("date", F.col("ic").alias("ic_pool"))
    w = Window.partitionBy("date")
    y = x.withColumn("__r", F.row_number().over(w.orderBy(F.desc(score), "symbol"))).withColumn("__p", F.row_number().over(Window.partitionBy("date", "__in").orderBy(F.desc(score), "symbol")))
    top = y.where(F.col("__in") & (F.col("__p") <= n)).groupBy("date").agg(F.avg((F.col("__r") <= n).cast("double")).alias("overlap"))
    return a.join(b, "date", "left").join(top, "date", "left")


def isolate(weights: DataFrame, health: DataFrame) -> DataFrame:
    """Weights of unstable factors become zero and the others are scaled to one (a row for each factor)."""
    x = weights.join(health.select("factor", "unstable"), "factor", "left")
    raw = F.when(F.coalesce("unstable", F.lit(False)), 0.0).otherwise(F.col("weight"))
    total = F.sum(raw).over(Window.partitionBy())
    return x.select("factor", F.when(total > 0, raw / total).otherwise(0.0).alias("weight"), F.coalesce("unstable", F.lit(False)).alias("isolated"))


def routed_weights(weights: DataFrame, multipliers: DataFrame, dynamic: DataFrame | None = None, blend: float = 0.0) -> DataFrame:
    """Weights of each regime: multiplied, blended with dynamic ones, negative ones dropped, scaled to one."""
    x = weights.join(F.broadcast(multipliers), "factor")
    if dynamic is not None:
        x = x.join(F.broadcast(dynamic.select("factor", F.col("weight").alias("__d"))), "factor", "left").withColumn("weight", (1 - blend) * F.col("weight") + blend * F.coalesce("__d", F.col("weight")))
    raw = F.greatest(F.col("weight") * F.col("multiplier"), F.lit(0.0))
    return x.select("regime", "factor", (raw / F.sum(raw).over(Window.partitionBy("regime"))).alias("weight"))


def temporal_split(df: DataFrame, order: str, validation: int, purge: int) -> DataFrame:
    """train, purge or validation by the distance to the last row (a row for each day)."""
    k = F.row_number().over(Window.orderBy(F.desc(order)))
    return df.withColumn("part", F.when(k <= validation, F.lit("validation")).when(k <= validation + purge, F.lit("purge")).otherwise(F.lit("train")))


def promotion(ics: DataFrame, n: int = 20, least_mean: float = 0.0, least_win: float = 0.5, streak: int = 3) -> DataFrame:
    """Whether the last n matured days pass the thresholds on ``streak`` evaluations in a row (gaps and islands)."""
    own = Window.partitionBy("factor").orderBy("date")
    w = own.rowsBetween(-(n - 1), 0)
    x = ics.where("ic is not null").select("factor", "date", (F.count("ic").over(w) >= n).alias("full"), F.avg("ic").over(w).alias("m"), F.avg((F.col("ic") > 0).cast("double")).over(w).alias("win"))
    x = x.withColumn("ok", F.col("full") & (F.col("m") >= least_mean) & (F.col("win") >= least_win))
    x = x.withColumn("__g", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(Window.partitionBy("factor", "__g").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("factor", "date", "ok", run.alias("streak"), (run >= streak).alias("promoted"))


def feature_selection(long: DataFrame, n: int = 20, threshold: float = 0.0, at_least: int = 1) -> DataFrame:
    """Mean of value times forward return by factor over the last n days; kept if above the threshold or among the first."""
    by_day = long.where("value is not null and label is not null").groupBy("date", "factor").agg(F.avg(F.col("value") * F.col("label")).alias("p"))
    x = ic.latest(by_day, ["factor"], n).groupBy("factor").agg(F.avg("p").alias("score"))
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("score")), "factor"))  # a row for each factor
    return x.withColumn("kept", (F.abs("score") >= threshold) | (place <= at_least))


def compare_versions(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """One row: shared windows, mean change, and those whose picks differ."""
    x = old.select(key, F.col(value).alias("a"), F.col("picks").alias("pa")).join(new.select(key, F.col(value).alias("b"), F.col("picks").alias("pb")), key)
    diff = F.size(F.array_except("pa", "pb")) + F.size(F.array_except("pb", "pa"))
    return x.agg(F.count(F.lit(1)).alias("windows"), F.avg(F.col("b") - F.col("a")).alias("mean_change"), F.count_if(diff > 0).alias("changed"), F.sum(diff).alias("names"))


def exposure_penalty(weights: DataFrame, limit: float = 0.4) -> DataFrame:
    """Concentration of each day's factor weights and the sum of what exceeds the limit."""
    return weights.groupBy("date").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.sum(F.greatest(F.abs("weight") - limit, F.lit(0.0))).alias("penalty"))


def evidence_gate(summary: DataFrame, least_mean: float = 0.0, least_positive: float = 0.5, least_days: int = 20) -> DataFrame:
    """Status of each row of an IC summary and of all together: the worst one."""
    s = F.when(F.col("days") < least_days, 1).when((F.col("ic_mean") >= least_mean) & (F.col("win_rate") >= least_positive), 0).otherwise(2)
    names = F.array(*map(F.lit, ("PASS", "INSUFFICIENT_DATA", "FAIL")))
    x = summary.withColumn("__s", s)
    return x.select("factor", F.element_at(names, F.col("__s") + 1).alias("status"), F.element_at(names, F.max("__s").over(Window.partitionBy()) + 1).alias("overall"))


def percent_or_ratio(df: DataFrame, c: str) -> DataFrame:
    """The column as a ratio: percent points are found by the 99.9 % quantile of its absolute values (one row)."""
    big = exact_quantiles(df, F.abs(c), (0.999,)).select((F.col("q0") > 0.5).alias("__pct"))
    return df.crossJoin(F.broadcast(big)).withColumn(c, F.when(F.coalesce("__pct", F.lit(False)), F.col(c) / 100).otherwise(F.col(c))).drop("__pct")


@dataclass(frozen=True)
class Hypothesis:
    """A factor that is claimed to predict returns: an SQL expression over the panel's columns, and the sign of its IC."""

    name: str
    expression: str
    fields: tuple[str, ...]
    direction: int = 1


def lint(h: Hypothesis, available: set[str], ahead: tuple[str, ...] = ("future_", "fwd_", "label")) -> str:
    """Why a hypothesis can't be tried, or an empty string: fields that the panel lacks, or that know what comes later."""
    used = set(h.fields)
    if missing := sorted(used - available):
        return "unknown fields: " + ", ".join(missing)
    if late := sorted(f for f in used if f.startswith(ahead)):
        return "looks ahead: " + ", ".join(late)
    return "" if h.direction in (-1, 1) else "direction"


def validate_batch(panel: DataFrame, hypotheses: list[Hypothesis], evaluator: Callable[[DataFrame], DataFrame] | None = None, label: str = "label", least_ic: float = 0.01, segments: int = 4, least: int = 30) -> DataFrame:
    """(factor, stage, status, reasons): hypotheses are linted, then tried on evidence, and only what passes both goes on.

    ``evaluator`` gets the long table (date, symbol, factor, value, label) of the hypotheses that passed, once for all of
    them, and gives (factor, passed); it isn't called if none passed and never sees a rejected one.  The list is as short as
    its writer makes it; the panel's rows stay in Spark."""
    spark = panel.sparkSession
    problems = {h.name: lint(h, set(panel.columns) - {label}) for h in hypotheses}
    tried = [h for h in hypotheses if not problems[h.name]]
    rows = [(h.name, "lint_rejected", "rejected", problems[h.name]) for h in hypotheses if problems[h.name]]
    schema = "factor string, stage string, status string, reasons string"
    if not tried:
        return spark.createDataFrame(rows, schema)
    values = F.array(*[F.struct(F.lit(h.name).alias("factor"), F.expr(h.expression).cast("double").alias("value")) for h in tried])
    long = panel.select("date", "symbol", F.col(label).alias("label"), F.explode(values).alias("h")).select("date", "symbol", "h.factor", "h.value", "label")
    long = written(long)  # for the evidence and the evaluator
    signs = spark.createDataFrame([(h.name, h.direction) for h in tried], "factor string, direction int")
    found = evidence(long, segments, least).join(F.broadcast(signs), "factor")
    wrong = F.coalesce(F.signum("ic") != F.col("direction"), F.lit(True)) | F.coalesce(F.abs("ic") < least_ic, F.lit(True))
    found = found.select("factor", F.concat_ws(",", F.nullif("reasons", F.lit("")), F.when(wrong, F.lit("direction"))).alias("reasons")).collect()  # a row for each hypothesis
    rows += [(r["factor"], "evidence_rejected", "rejected", r["reasons"]) for r in found if r["reasons"]]
    passed = [r["factor"] for r in found if not r["reasons"]]
    done = spark.createDataFrame(rows, schema)
    if not passed:
        return done
    if evaluator is None:
        return done.unionByName(spark.createDataFrame([(f, "evidence_passed", "verified", "") for f in passed], schema))
    judged = evaluator(long.where(F.col("factor").isin(passed)))
    out = spark.createDataFrame([(f,) for f in passed], "factor string").join(judged.select("factor", "passed"), "factor", "left")
    status = F.when(F.coalesce("passed", F.lit(False)), F.lit("verified")).otherwise(F.lit("falsified"))
    return done.unionByName(out.select("factor", F.lit("return_evaluated").alias("stage"), status.alias("status"), F.lit("").alias("reasons")))


def daily_evaluator(metric: Callable, least: int = 5, least_mean: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """An evaluator for ``validate_batch`` from ``metric(values, labels) -> float`` over pandas series.

    The metric sees one factor's cross-section of a day at a time, as a grouped aggregate over Arrow batches, so a task never
    holds a whole factor; a factor passes if the mean of its days is above ``least_mean``.  Rows without value or label and days
    of fewer than ``least`` rows don't count."""
    def day(values: pd.Series, labels: pd.Series) -> float:
        return float(metric(values, labels))

    def rows(values: pd.Series) -> int:  # a built-in count can't stand beside these
        return len(values)

    def judge(long: DataFrame) -> DataFrame:
        x = long.where(F.col("value").isNotNull() & F.col("label").isNotNull())
        days = x.groupBy("factor", "date").agg(F.pandas_udf(day, "double")(F.col("value"), F.col("label")).alias("m"), F.pandas_udf(rows, "long")(F.col("value")).alias("n")).where(F.col("n") >= least)
        return days.groupBy("factor").agg(F.count("m").alias("days"), F.avg("m").alias("mean")).withColumn("passed", F.coalesce(F.col("mean") > least_mean, F.lit(False)))

    return judge


def upper_half(values, labels):
    """Mean label of the values above their median less that of the others."""
    above = values > values.median()
    return labels[above].mean() - labels[~above].mean() if above.any() and not above.all() else float("nan")
