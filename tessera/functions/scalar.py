"""Column builders: null-safe arithmetic, clip scores, codes, dates, costs, and the time-series and cross-section operators."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become null, which aggregates skip."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def clip_score(c: Column | str, lo: float, hi: float, invert: bool = False) -> Column:
    """Linear score from 0 at ``lo`` to 1 at ``hi``; missing is 0.5."""
    x = clip((col(c) - lo) / (hi - lo), 0, 1)
    return F.coalesce(1 - x if invert else x, F.lit(0.5))


def safe_div(a: Column, b: Column, default: float | None = None, eps: float = 1e-9) -> Column:
    """a / b where |b| exceeds eps, else the default (null by default)."""
    return F.when(F.abs(b) > eps, a / b).otherwise(F.lit(default).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: over zero it is infinite or, for zero itself and NaN, NaN; Spark's own division is an error there."""
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def safe_log(c: Column, default: float | None = None, eps: float = 1e-9) -> Column:
    return F.when(F.abs(c) > eps, F.log(F.abs(c))).otherwise(F.lit(default).cast("double"))


def safe_sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def safe_inv(c: Column, eps: float = 1e-9) -> Column:
    return safe_div(F.lit(1.0), c, None, eps)


def sign(c: Column) -> Column:
    return F.signum(c)


def c_log(c: Column) -> Column:
    """Logarithm of the C library, whose last bit is not always that of Spark's own; null where there is none."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None or v <= 0 else math.log(v) for v in x.to_pylist()], pa.float64())

    return F.arrow_udf(run, DoubleType())(c)


def c_exp(c: Column) -> Column:
    """Exponential of the C library; infinite beyond the largest double."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.inf if v > 709.782712893384 else math.exp(v) for v in x.to_pylist()], pa.float64())

    return F.arrow_udf(run, DoubleType())(c)


def round_product(c: Column | str, n: int) -> Column:
    """n places by rounding c times 10^n, halves away from zero: what lies within a bit of a half goes as that product does, not as the shortest decimals do."""
    x = col(c) * 10.0**n
    return F.when(F.abs(x) == float("inf"), col(c)).otherwise(F.round(x) / 10.0**n)


# codes and dates


def canonical_code(c: Column | str) -> Column:
    """Six digits without suffix; what isn't digits stays as it is."""
    bare = F.element_at(F.split(F.trim(col(c)), r"\."), 1)
    return F.when(bare.rlike(r"^\d{1,6}$"), F.lpad(bare, 6, "0")).otherwise(bare)


def suffixed_code(c: Column | str) -> Column:
    bare = canonical_code(c)
    head = F.substring(bare, 1, 1)
    return F.when(head.isin("6", "9"), F.concat(bare, F.lit(".SH"))).when(head.isin("4", "8"), F.concat(bare, F.lit(".BJ"))).otherwise(F.concat(bare, F.lit(".SZ")))


def has_prefix(c: Column | str, prefixes: list[str]) -> Column:
    n = {len(p) for p in prefixes}
    out = F.lit(False)
    for k in sorted(n):
        out = out | F.substring(col(c), 1, k).isin([p for p in prefixes if len(p) == k])
    return out


def six_digits(c: Column | str) -> Column:
    return col(c).rlike(r"^\d{6}$")


def daily_limit(code: Column, name: Column) -> Column:
    """Rate of the daily price limit: special treatment, growth boards, the Beijing board, others."""
    return F.when(F.upper(name).rlike("ST|退"), 0.05).when(F.substring(code, 1, 2).isin("30", "68"), 0.20).when(F.substring(code, 1, 1).isin("4", "8"), 0.30).otherwise(0.10)


def norm_date(c: Column | str) -> Column:
    """Dates of eight digits, with or without separators."""
    digits = F.regexp_replace(col(c).cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")).cast("date"))


def number_with_unit(c: Column | str) -> Column:
    """'1.04亿', '5833万', '12%', '-' and blanks to numbers or null."""
    s = F.regexp_replace(F.trim(col(c)), ",", "")
    n = F.regexp_extract(s, r"^([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    return n * F.when(s.contains("亿"), 1e8).when(s.contains("万"), 1e4).otherwise(1.0)


def available_on(period: Column | str) -> Column:
    """The date from which a report may be used: the last day on which its quarter must be published."""
    p, y = col(period), F.year(col(period))
    m = F.month(p)
    return (
        F.when(m == 12, F.make_date(y + 1, F.lit(4), F.lit(30)))
        .when(m == 3, F.make_date(y, F.lit(4), F.lit(30)))
        .when(m == 6, F.make_date(y, F.lit(8), F.lit(31)))
        .when(m == 9, F.make_date(y, F.lit(10), F.lit(31)))
        .otherwise(F.make_date(y, F.lit(12), F.lit(31)))
    )


def quarter_index(period: Column | str) -> Column:
    p = col(period)
    return F.year(p) * 4 + F.floor(F.month(p) / 3).cast("int") - 1


# costs


def commission(amount: Column, rate: float = 0.00025, least: float = 5.0) -> Column:
    return F.greatest(amount * rate, F.lit(least))


def fees(amount: Column, side: Column, rate: float = 0.00025, stamp: float = 0.0005, transfer: float = 0.00001) -> Column:
    """Commission with its minimum, stamp duty on sells, transfer fee."""
    return commission(amount, rate) + F.when(side == "sell", amount * stamp).otherwise(0.0) + amount * transfer


def impact_rate(order: Column, adv: Column, vol: Column, permanent: float = 0.1, temporary: float = 0.5, lo: float = 1e-4, hi: float = 0.02) -> Column:
    """Slippage rate of an order: permanent and temporary impact of its share of the daily volume, clipped."""
    p = clip(safe_div(order, adv, 1.0), 0, 1)
    return clip(permanent * p + temporary * p * vol, lo, hi)


def execution_risk(vol: Column, horizon: float = 1.0, kappa: float = 1.0, days: int = 252) -> Column:
    return vol * (horizon / days) ** 0.5 * kappa


# time series, over (symbol, date)


def by_symbol(symbol: str = "symbol", date: str = "date") -> Window:
    return Window.partitionBy(symbol).orderBy(date)


def ts(fn: str, c: Column | str, w: int, least: int | None = None, symbol: str = "symbol", date: str = "date") -> Column:
    """Rolling mean, std, min, max, sum, rank or zscore over the last w rows; null before row w or under ``least`` values."""
    c, own = col(c), by_symbol(symbol, date)
    frame = own.rowsBetween(-(w - 1), 0)
    n = F.count(c).over(frame)
    least = w // 2 + 1 if least is None else least
    avg, std = F.avg(c).over(frame), F.stddev_samp(c).over(frame)
    if fn == "rank":
        value = F.size(F.filter(F.collect_list(c).over(frame), lambda x: x <= c)) / n
    else:
        value = {"mean": avg, "std": std, "min": F.min(c).over(frame), "max": F.max(c).over(frame), "sum": F.sum(c).over(frame), "zscore": F.when(std > 1e-12, (c - avg) / std).otherwise(0.0)}[fn]
    return F.when((F.row_number().over(own) >= w) & (n >= least), value)


def ts_delta(c: Column | str, w: int, symbol: str = "symbol", date: str = "date") -> Column:
    return col(c) - F.lag(col(c), w).over(by_symbol(symbol, date))


# cross sections, over a day (or any keys)


def average_rank(c: Column | str, *keys: str) -> Column:
    """Rank from 1 with ties at their mean; null for null.

    The mean of the first and the last place of a value: both come from one window, so a rank costs one sort."""
    c = col(c)
    w = Window.partitionBy(*keys).orderBy(c.asc_nulls_last())
    return F.when(c.isNotNull(), (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2)


def cs_rank(c: Column | str, *keys: str) -> Column:
    """Average rank by the number of values, in (0, 1]."""
    return average_rank(c, *keys) / F.count(col(c)).over(Window.partitionBy(*keys))


def rank_percentile(c: Column | str, *keys: str) -> Column:
    """Average rank from 0 to 1; missing and lone values are 0.5."""
    n = F.count(col(c)).over(Window.partitionBy(*keys))  # after the rank, whose sort serves it too
    return F.coalesce((average_rank(c, *keys) - 1) / F.nullif(n - 1, F.lit(0)), F.lit(0.5))


def cs_demean(c: Column | str, *keys: str) -> Column:
    return col(c) - F.avg(col(c)).over(Window.partitionBy(*keys))


def cs_zscore(c: Column | str, *keys: str, population: bool = False) -> Column:
    w = Window.partitionBy(*keys)
    std = (F.stddev_pop if population else F.stddev_samp)(col(c)).over(w)
    return F.when(col(c).isNull(), F.lit(None)).when(std > 1e-12, cs_demean(c, *keys) / std).otherwise(0.0)


def winsorize(c: Column | str, *keys: str, lo: float = 0.01, hi: float = 0.99) -> Column:
    """Values beyond the interpolated quantiles of their cross-section become those quantiles."""
    q = F.percentile(col(c), F.array(F.lit(lo), F.lit(hi))).over(Window.partitionBy(*keys))
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), q[0]), q[1]))


# aggregates


def correlation(a: Column | str, b: Column | str, eps: float = 1e-12) -> Column:
    """Pearson correlation over rows that have both; null without variance."""
    x, y = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > eps) & (sy > eps), F.covar_pop(x, y) / (sx * sy))
