"""Point-in-time joins: what was known on each date, by one union and one window, never by an inequality join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, on: str, right_on: str, order: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    """Each left row with the newest right row of its key whose ``right_on`` isn't later than ``on``.

    Rows of both sides are sorted together by key and date, right rows first on a shared date; ``order`` breaks ties of the
    right side (the last wins).  One shuffle on the key, whatever the number of dates."""
    values = values or [c for c in right.columns if c not in (key, right_on)]
    order = order or []
    lcols = left.columns
    pack = F.struct(*[F.col(c) for c in values])
    r = right.where(F.col(right_on).isNotNull()).select(F.col(key), F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.struct(*[F.col(c) for c in order], F.lit(0)).alias("__o"), pack.alias("__v"))
    kind = dict(left.dtypes)
    r = r.select("*", *[F.lit(None).cast(kind[c]).alias(f"__l_{c}") for c in lcols])
    none = r.select("__o", "__v").schema
    lf = left.select(F.col(key), F.col(on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(none["__o"].dataType).alias("__o"), F.lit(None).cast(none["__v"].dataType).alias("__v"), *[F.col(c).alias(f"__l_{c}") for c in lcols])
    w = Window.partitionBy(key).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(lf).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*[F.col(f"__l_{c}").alias(c) for c in lcols], *[F.col(f"__v.{c}").alias(c) for c in values])


def latest_within(df: DataFrame, key: str, ts: str, as_of, days: int = 400, prefer: str | None = None) -> DataFrame:
    """The newest row of each key up to ``as_of`` and at most ``days`` back; rows with ``prefer`` win ties."""
    order = [F.desc(ts)] + ([F.col(prefer).isNotNull().desc()] if prefer else [])
    x = df.where((F.col(ts) <= F.lit(as_of)) & (F.col(ts) > F.date_sub(F.lit(as_of), days)))
    return x.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def patch_value(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The newest non-null value of each key, or null if it has none."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(F.col(value).isNotNull(), F.col(ts))).alias(value))


def checked_left_join(left: DataFrame, right: DataFrame, keys: list[str], fill: dict[str, str]) -> DataFrame:
    """Left join that keeps the left rows: a right side that repeats a key is an error in the row's task.

    ``fill`` maps a left column to the right one that fills its nulls."""
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(f"__r_{c}") for c in fill.values()])
    # an assertion that Spark can't drop: its value decides the column
    one = one.withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit("the right side repeats a key")).cast("int")).otherwise(1))
    out = left.join(one, keys, "left")
    return out.select(*[F.when(F.coalesce("__ok", F.lit(1)) == 1, F.coalesce(F.col(c), F.col(f"__r_{fill[c]}"))).alias(c) if c in fill else F.col(c) for c in left.columns])


def year_ago(fin: DataFrame, values: dict[str, str]) -> DataFrame:
    """Differences to the same quarter of the year before (``values`` maps columns to the new names); gaps stay gaps.

    The frame holds just the quarter four back, so all of them cost one shuffle and no join."""
    from tessera.functions.scalar import quarter_index

    w = Window.partitionBy("symbol").orderBy(quarter_index("period")).rangeBetween(-4, -4)
    return fin.withColumns({name: F.col(c) - F.max(c).over(w) for c, name in values.items()})


def quality_gated(snap: DataFrame, ts: str, cap: str, least_rows: int, least_cover: float = 0.8, prefix: str | None = None, key: str = "symbol") -> DataFrame:
    """The newest snapshot whose rows, coverage and required prefix pass; if none does, each key's own latest row."""
    ok = (F.count(F.lit(1)) >= least_rows) & (F.count(cap) / F.count(F.lit(1)) >= least_cover)
    if prefix:
        ok = ok & (F.count_if(F.col(key).startswith(prefix)) > 0)
    best = snap.groupBy(ts).agg(ok.alias("__ok")).where("__ok").agg(F.max(ts).alias("__best"))  # one row
    x = snap.crossJoin(F.broadcast(best))
    own = F.max(ts).over(Window.partitionBy(key))
    return x.withColumn("__own", own).where(F.when(F.col("__best").isNotNull(), F.col(ts) == F.col("__best")).otherwise(F.col(ts) == F.col("__own"))).drop("__best", "__own")


def holding_events(positions: DataFrame, events: DataFrame, applied: DataFrame, as_of) -> DataFrame:
    """Events of held symbols from the buying day to ``as_of`` that aren't applied yet: equi-join on the symbol, then the range."""
    x = positions.join(events, "symbol").where((F.col("ex_date") >= F.col("buy_date")) & (F.col("ex_date") <= F.lit(as_of)))
    return x.join(applied, ["symbol", "ex_date"], "left_anti")


def adjust(bars: DataFrame, factors: DataFrame, mode: str = "qfq") -> DataFrame:
    """Closes times the cumulative factor in force (1 if none); forward adjustment divides by the symbol's largest factor."""
    x = asof(bars, factors, "symbol", "date", "ex_date", values=["factor"]).withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    base = F.max("factor").over(Window.partitionBy("symbol")) if mode == "qfq" else F.lit(1.0)
    return x.withColumn("adj_close", F.round(F.col("close") * F.col("factor") / base, 4))
