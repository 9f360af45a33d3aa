"""Joins, filters, set operations, rankings and aggregates of daily panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators.quantiles import exact_quantiles


def latest(df: DataFrame, c: str):
    """The largest value of a column, one scalar to the driver; over a file's own column Spark takes it from the footers' pages."""
    return df.agg(F.max(c)).first()[0]


def recent_window(df: DataFrame, days: int, date: str = "date") -> DataFrame:
    """Rows of the last ``days`` days up to the table's latest date: a scalar first, then a filter by a literal, which reaches
    the scan where ``date`` is a column of the file.  An empty table stays empty."""
    top = latest(df, date)
    return df.where(F.col(date) >= F.date_sub(F.lit(top), days)) if top is not None else df.where(F.lit(False))


def up_to(df: DataFrame, moment, ts: str = "date") -> DataFrame:
    """Nothing later than the decision time."""
    return df.where(F.col(ts) <= F.lit(moment))


def filter_universe(df: DataFrame, as_of: str, prefixes: list[str] | None = None, cap: tuple[float, float] = (50.0, 2000.0), least_turnover: float = 0.0, listed_days: int = 120) -> DataFrame:
    """Tradable names: prefix, name, special treatment (unknown is kept), float cap (unknown is kept; its unit is found from
    the median), turnover, amount, and days since listing (unknown is kept, and the rule holds only if some are known)."""
    out = df.where(S.has_prefix("symbol", prefixes)) if prefixes else df
    out = out.where(~F.coalesce(F.col("name").rlike("ST|退"), F.lit(False)) & ~F.coalesce("is_st", F.lit(False)))
    # one row decides the unit and whether any listing date is known
    big = exact_quantiles(out, "float_cap", (0.5,)).select((F.col("q0") > 1e6).alias("__big"))
    out = out.crossJoin(F.broadcast(big)).crossJoin(F.broadcast(out.agg((F.count("list_date") > 0).alias("__dated"))))
    c = F.when(F.coalesce("__big", F.lit(False)), F.col("float_cap") / 1e8).otherwise(F.col("float_cap"))
    out = out.where(c.isNull() | c.between(*cap)).where((F.col("turnover") >= least_turnover) & (F.col("amount") > 0))
    old = F.date_diff(F.lit(as_of).cast("date"), F.col("list_date")) >= listed_days
    return out.where(~F.col("__dated") | F.col("list_date").isNull() | old).drop("__big", "__dated")


def limit_prices(bars: DataFrame, rate: Column) -> DataFrame:
    prev = F.lag("close").over(S.by_symbol())
    return bars.withColumns({"limit_up": F.round(prev * (1 + rate), 2), "limit_down": F.round(prev * (1 - rate), 2)})


def market_breadth(bars: DataFrame, limit: float = 9.5) -> DataFrame:
    c = F.col("change_pct")
    out = bars.where(c.isNotNull()).groupBy("date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c > 0).alias("up"), F.count_if(c < 0).alias("down"), F.count_if(c == 0).alias("flat"), F.count_if(c >= limit).alias("limit_up"),
        F.count_if(c <= -limit).alias("limit_down"), F.sum("amount").alias("amount"), F.avg(c).alias("avg_change"),
    )
    return out.withColumn("breadth", (F.col("up") - F.col("down")) / F.col("total"))


def sentiment(bars: DataFrame) -> DataFrame:
    """Counts, median, strong names and a score from 1 to 99 for each day."""
    c = F.col("change_pct")
    x = bars.where(c.isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg((c > 0).cast("double")).alias("up"), F.median(c).alias("median"), F.avg((c >= 3).cast("double")).alias("strong"), F.avg((c >= 9.5).cast("double")).alias("limit_up"), F.sum("amount").alias("amount"))
    score = 100 * (0.35 * F.col("up") + 0.25 * S.clip((F.col("median") + 5) / 10, 0, 1) + 0.25 * F.col("strong") + 0.15 * S.clip(F.col("limit_up") * 10, 0, 1))
    return x.withColumn("score", S.clip(score, 1, 99))


def adv_vol(bars: DataFrame, sessions: int = 20, year: int = 252, default: float = 0.025) -> DataFrame:
    """Average amount and annualised deviation of each symbol over the last sessions of the calendar."""
    days = bars.select("date").distinct().orderBy(F.desc("date")).limit(sessions)  # a row for each session
    x = bars.join(F.broadcast(days), "date").groupBy("symbol").agg(F.avg("amount").alias("adv"), F.stddev_samp("change_pct").alias("__s"), F.count("change_pct").alias("n"))
    ok = (F.col("n") >= 5) & F.col("__s").isNotNull()
    return x.select("symbol", "adv", "n", (F.when(ok, F.col("__s") / 100).otherwise(default) * year**0.5).alias("vol"), F.when(ok, F.lit("sample")).otherwise(F.lit("fallback")).alias("vol_source"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], fields: dict[str, float]) -> DataFrame:
    """One row: common, left-only and right-only keys, and for each field the rows that differ by more than its tolerance and the mean ratio."""
    x = a.select(*keys, *[F.col(f).alias(f"__a_{f}") for f in fields], F.lit(1).alias("__l")).join(b.select(*keys, *[F.col(f).alias(f"__b_{f}") for f in fields], F.lit(1).alias("__r")), keys, "full_outer")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    agg = [F.count_if(both).alias("common"), F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right")]
    for f, tol in fields.items():
        p, q = F.col(f"__a_{f}"), F.col(f"__b_{f}")
        agg += [F.count_if(both & (F.abs(p - q) > tol)).alias(f"diff_{f}"), F.avg(F.when(both & (F.abs(q) > 1e-12), p / q)).alias(f"ratio_{f}")]
    return x.agg(*agg)


def ratio_buckets(a: DataFrame, b: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Rows of each day by the ratio of two sources: about 1, 0.01 or 100, zero, missing, other."""
    x = a.select(*keys, F.col(field).alias("__a")).join(b.select(*keys, F.col(field).alias("__b")), keys)
    r = S.safe_div(F.col("__a"), F.col("__b"), eps=1e-12)
    near = lambda v: F.abs(r / v - 1) < 0.05
    bucket = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.lit("nan")).when((F.col("__a") == 0) | (F.col("__b") == 0), F.lit("zero")).when(near(1.0), F.lit("~1")).when(near(0.01), F.lit("~0.01")).when(near(100.0), F.lit("~100")).otherwise(F.lit("other"))
    return x.groupBy("date", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, score: str, n: int, *keys: str, tie: str = "symbol") -> DataFrame:
    """The n best of each cross-section, nulls last, ties by symbol."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Fixed weights of the selection score.
SELECT_WEIGHTS = {"f_signal": 0.25, "f_trend": 0.2, "f_govern": 0.1, "f_liquidity": 0.15, "f_vol": 0.15, "f_mom_rev": 0.15}


def selection(scores: DataFrame, n: int = 10, weights: dict[str, float] | None = None, blend: float = 0.0, fusion: str | None = None) -> DataFrame:
    """Weighted sum of rank-normalised components for every day, blended with a fusion score's rank if given, and its top n."""
    weights = weights or SELECT_WEIGHTS
    x = scores
    for c in weights:
        x = x.withColumn(f"__p_{c}", S.rank_percentile(c, "date"))
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.col(f"__p_{c}")
    x = x.withColumn("score", total)
    if fusion:
        x = x.withColumn("__f", S.rank_percentile(fusion, "date")).withColumn("score", (1 - blend) * F.col("score") + blend * F.col("__f"))
    x = x.withColumn("score", F.round("score", 9))  # scores that differ by less are ties
    return top_n(x, "score", n, "date").select("date", "symbol", "score", "rank")


def gain_days(curve: DataFrame, k: int = 5, run: int = 5) -> DataFrame:
    """Share of the k best days in all gains, and the best and worst sum of ``run`` days, by curve."""
    w = Window.partitionBy("curve_id")
    x = curve.select("curve_id", "date", "ret", F.row_number().over(w.orderBy(F.desc("ret"), "date")).alias("__top"), F.sum("ret").over(w.orderBy("date").rowsBetween(-(run - 1), 0)).alias("__run"), F.row_number().over(w.orderBy("date")).alias("__k"))
    gains = F.sum(F.when(F.col("ret") > 0, F.col("ret")))
    return x.groupBy("curve_id").agg((F.sum(F.when((F.col("__top") <= k) & (F.col("ret") > 0), F.col("ret"))) / gains).alias("top_share"), F.max(F.when(F.col("__k") >= run, F.col("__run"))).alias("best_run"), F.min(F.when(F.col("__k") >= run, F.col("__run"))).alias("worst_run"))


def streaks(events: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Length of the failures since the last success of each key, by counting successes as group numbers."""
    w = Window.partitionBy(key).orderBy(order)
    x = events.withColumn("__f", failed).withColumn("__g", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("__g").over(Window.partitionBy(key))
    return x.withColumn("__last", last).groupBy(key).agg(F.sum(F.when(F.col("__f") & (F.col("__g") == F.col("__last")), 1).otherwise(0)).alias("failures"))


def rank_agreement(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Jaccard of two top-n rankings of each day and 1 - 6 sum(d^2) / (n (n^2 - 1)) over their common names."""
    x = a.select("date", "symbol", F.col("rank").alias("ra")).join(b.select("date", "symbol", F.col("rank").alias("rb")), ["date", "symbol"], "full_outer")
    both = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    # ranks are counted again among the common names
    w = Window.partitionBy("date", both)
    x = x.withColumn("__d", F.when(both, F.row_number().over(w.orderBy("ra")) - F.row_number().over(w.orderBy("rb"))))
    m = F.count_if(both)
    return x.groupBy("date").agg((m / F.count(F.lit(1))).alias("jaccard"), m.alias("common"), F.when(m > 1, 1 - 6 * F.sum(F.col("__d") * F.col("__d")) / (m * (m * m - 1))).alias("rank_corr"))


def tag_counts(rows: DataFrame, tags: str, k: int) -> DataFrame:
    """The k most frequent tags, ties by name."""
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def row_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """A digest of the rows that doesn't depend on their order: sums and exclusive or of row hashes, and their number."""
    h = F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(cols))).cast("binary")), 1, 12), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum("h").alias("digest_sum"), F.bit_xor("h").alias("digest_xor"))
