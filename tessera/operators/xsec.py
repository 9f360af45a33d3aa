"""Cross-section operators: neutralisation, composites, quantile groups; all days in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import average_rank, col, cs_zscore, winsorize


def neutralize(df: DataFrame, factors: list[str], size: str = "ln_size", industry: str = "industry", day: str = "date", least: int = 30) -> DataFrame:
    """Residual z-score of each factor on size and industry, as columns ``z_<factor>``.

    Group dummies and one regressor have a closed form: demean both within (day, industry), then the slope is one ratio of
    sums over the day; residuals are scaled by their population deviation.  A missing industry is a group of its own.
    Days with fewer than ``least`` complete values, or without variance, give null."""
    ind = F.coalesce(F.col(industry).cast("string"), F.lit("?"))
    df = df.withColumn("__ind", ind)
    group, whole = Window.partitionBy(day, "__ind"), Window.partitionBy(day)
    # all factors take each step together, so the steps cost one sort each, not one for each factor
    ok = {f: F.col(f).isNotNull() & F.col(size).isNotNull() for f in factors}
    df = df.withColumns({f"__y_{f}": F.when(ok[f], F.col(f)) for f in factors} | {f"__x_{f}": F.when(ok[f], F.col(size)) for f in factors})
    df = df.withColumns({f"__y_{f}": winsorize(f"__y_{f}", day) for f in factors})
    df = df.withColumns({f"__{v}_{f}": F.col(f"__{v}_{f}") - F.avg(f"__{v}_{f}").over(group) for f in factors for v in "xy"})
    sums = {f"__xx_{f}": F.sum(F.col(f"__x_{f}") * F.col(f"__x_{f}")).over(whole) for f in factors} | {f"__xy_{f}": F.sum(F.col(f"__x_{f}") * F.col(f"__y_{f}")).over(whole) for f in factors}
    df = df.withColumns(sums)
    beta = {f: F.when(F.col(f"__xx_{f}") > 1e-12, F.col(f"__xy_{f}") / F.col(f"__xx_{f}")).otherwise(0.0) for f in factors}
    df = df.withColumns({f"__r_{f}": F.col(f"__y_{f}") - beta[f] * F.col(f"__x_{f}") for f in factors})

    def scaled(r: str) -> Column:
        std = F.stddev_pop(r).over(whole)
        return F.when((F.count(r).over(whole) >= least) & (std > 1e-12), (F.col(r) - F.avg(r).over(whole)) / std)

    df = df.withColumns({f"z_{f}": scaled(f"__r_{f}") for f in factors})
    return df.drop("__ind", *[f"__{v}_{f}" for f in factors for v in ("x", "y", "r", "xx", "xy")])


def composite(df: DataFrame, weights: dict[str, float], directions: dict[str, int], day: str = "date", least: int = 30) -> DataFrame:
    """Weighted sum of z-scores with their signs over the factors a row has, scaled by the weights it has, then z-scored."""
    parts = [(F.col(f"z_{f}") * directions.get(f, 1) * w, F.when(F.col(f"z_{f}").isNotNull(), F.lit(w)).otherwise(0.0)) for f, w in weights.items()]
    total, have = F.lit(0.0), F.lit(0.0)
    for value, w in parts:
        total, have = total + F.coalesce(value, F.lit(0.0)), have + w
    df = df.withColumn("__raw", F.when(have > 0, total / have))
    n = F.count("__raw").over(Window.partitionBy(day))
    return df.withColumn("score", F.when(n >= least, cs_zscore("__raw", day, population=True))).drop("__raw")


def watch_score(df: DataFrame, day: str = "date") -> DataFrame:
    """(|revenue growth| - (profit growth + ROE change)) / (|ROE| + sqrt(book value)) on neutralised inputs; undefined rows get a reason."""
    # a lone member of an industry has residual zero but for its last bits, whose sign means nothing
    bv, num = F.round("z_bvps", 9), F.abs("z_rev_yoy") - (F.col("z_np_yoy") + F.col("z_roe_yy_chg"))
    den = F.abs("z_roe") + F.sqrt(F.when(bv >= 0, bv))
    missing = F.greatest(*[F.col(c).isNull() for c in ("z_bvps", "z_rev_yoy", "z_np_yoy", "z_roe_yy_chg", "z_roe")])
    reason = F.when(missing, F.lit("missing")).when(bv < 0, F.lit("bvps_neg")).when(den < 1e-9, F.lit("div_nonfinite"))
    return df.withColumn("reason", reason).withColumn("watch", F.when(F.col("reason").isNull(), num / den))


def quantile_bucket(c: str, k: int, *keys: str) -> Column:
    """Bucket 1 to k by interpolated cut-points, so that ties share a bucket (intervals closed on the right)."""
    cuts = F.percentile(F.col(c), F.array(*[F.lit(i / k) for i in range(1, k)])).over(Window.partitionBy(*keys))
    return F.when(F.col(c).isNotNull(), F.size(F.filter(cuts, lambda q: q < F.col(c))) + 1)


def order_bucket(c: str, k: int, *keys: str, tie: str = "symbol") -> Column:
    """Bucket 0 to k - 1 of equal counts by rank order: floor(place * k / n)."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(F.col(c), F.col(tie))) - 1
    return F.floor(place * k / F.count(F.lit(1)).over(w)).cast("int")


def quantile_means(df: DataFrame, factor: str, label: str, k: int = 5, day: str = "date") -> DataFrame:
    """Mean label of each bucket by day, over days that fill all buckets, then over days."""
    x = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).withColumn("bucket", quantile_bucket(factor, k, day))
    by_day = x.groupBy(day, "bucket").agg(F.avg(label).alias("m")).withColumn("filled", F.count(F.lit(1)).over(Window.partitionBy(day)))
    return by_day.where(F.col("filled") == k).groupBy("bucket").agg(F.avg("m").alias("mean_return"), F.count(F.lit(1)).alias("days"))


def decile_spread(df: DataFrame, factor: str, label: str, day: str = "date", least: int = 10, share: float = 0.1, tie: str = "symbol") -> DataFrame:
    """Mean label of the top share minus the bottom share of each day, both rounded up."""
    x = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    w = Window.partitionBy(day)
    n = F.count(F.lit(1)).over(w)
    x = x.select(day, label, n.alias("n"), F.row_number().over(w.orderBy(F.desc(factor), tie)).alias("top"), F.row_number().over(w.orderBy(F.col(factor), tie)).alias("low"))
    k = F.ceil(F.col("n") * share)
    return x.where(F.col("n") >= least).groupBy(day).agg((F.avg(F.when(F.col("top") <= k, F.col(label))) - F.avg(F.when(F.col("low") <= k, F.col(label)))).alias("spread"), F.first("n").alias("n"))


def trim_top(c: str, q: float, *keys: str) -> Column:
    """Values above the 1 - q quantile of their cross-section become null."""
    return F.when(F.col(c) <= F.percentile(col(c), F.lit(1 - q)).over(Window.partitionBy(*keys)), F.col(c))


def melt(df: DataFrame, keys: list[str], values: list[str], name: str = "factor", value: str = "value") -> DataFrame:
    """Wide to long: one row for each value column."""
    return df.unpivot(keys, values, name, value)


__all__ = ["average_rank", "composite", "decile_spread", "melt", "neutralize", "order_bucket", "quantile_bucket", "quantile_means", "trim_top", "watch_score"]
