"""Exact quantiles of whole tables by distributed selection.

An exact percentile without a group, or over a few huge groups, would gather every distinct value in one task.  Here sketches
give a bracket that holds the ranks asked for, a count shows what lies below and inside it, and the bracket is narrowed until
few values are strictly inside; only those, counted by value, are put in order.  A round divides what is inside by thousands, so
a table of 10^12 rows takes three."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written

ACCURACY, FEW, ROUNDS = 10_000, 100_000, 40


def _bracket(values: Column, place: float) -> Column:
    """Values of which the first is not above and the second not below the value at a place in [0, 1], by the sketch's bound."""
    margin = 2 / ACCURACY
    return F.percentile_approx(values, F.array(F.lit(max(0.0, place - margin)), F.lit(min(1.0, place + margin))), ACCURACY)


def exact_quantiles(df: DataFrame, value: Column | str, qs: tuple[float, ...], by: tuple[str, ...] = (), accuracy_rows: int = FEW) -> DataFrame:
    """``(by..., n, q0, q1, ...)``: the count of non-null values and their quantiles, interpolated between neighbours as
    ``percentile`` does; groups of ``by`` are few (their brackets go through the driver).

    An empty table has no group, or one row of nulls without ``by``."""
    if accuracy_rows < 4 * ACCURACY:
        raise ValueError("a bracket of fewer rows than the sketches tell apart can't be narrowed")
    spark = df.sparkSession
    v = F.col(value) if isinstance(value, str) else value
    x = written(df.select(*by, v.cast("double").alias("__v")).where("__v is not null"))
    # a bracket for each group and quantile: the group, n, the rank below the quantile and the two values
    first = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[_bracket(F.col("__v"), q).alias(f"b{i}") for i, q in enumerate(qs)]).collect()
    open_ = [{"g": tuple(r[c] for c in by), "i": i, "n": r["n"], "k": min(int((r["n"] - 1) * q), r["n"] - 1), "lo": r[f"b{i}"][0], "hi": r[f"b{i}"][1]} for r in first for i, q in enumerate(qs) if r["n"]]
    done = []
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "i int, lo double, hi double"])

    def with_brackets(brackets: list[dict]) -> DataFrame:
        """Each row with the brackets of its group."""
        if not by:
            all_ = [F.struct(F.lit(b["i"]).alias("i"), F.lit(b["lo"]).alias("lo"), F.lit(b["hi"]).alias("hi")) for b in brackets]
            return x.withColumn("__b", F.explode(F.array(*all_))).select("__v", "__b.*")
        table = spark.createDataFrame([(*b["g"], b["i"], b["lo"], b["hi"]) for b in brackets], schema)
        return x.alias("x").join(F.broadcast(table).alias("b"), reduce(Column.__and__, [F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]))

    own = [F.col(f"b.{c}").alias(c) for c in by]
    for _ in range(ROUNDS):
        if not open_:
            break
        inside = (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))
        strictly = (F.col("__v") > F.col("lo")) & (F.col("__v") < F.col("hi"))
        counts = with_brackets(open_).select(*own, "i", "__v", "lo", "hi").groupBy(*by, "i").agg(F.count_if(F.col("__v") < F.col("lo")).alias("below"), F.count_if(inside).alias("inside"), F.count_if(strictly).alias("strictly")).collect()
        found = {(tuple(r[c] for c in by), r["i"]): r for r in counts}
        narrow = []
        for b in open_:
            r = found[b["g"], b["i"]]
            b["below"] = r["below"]
            if r["below"] > b["k"]:
                b["lo"] = float("-inf")
                narrow.append(b)
            elif r["below"] + r["inside"] <= min(b["k"] + 1, b["n"] - 1):
                b["hi"] = float("inf")
                narrow.append(b)
            elif r["strictly"] <= accuracy_rows or r["strictly"] > b.get("was", b["n"]):
                done.append(b)
            else:
                b["was"] = r["strictly"] // 2  # a round that doesn't halve it is the last
                b["place"] = (b["k"] - r["below"]) / max(1, r["inside"] - 1)
                narrow.append(b)
        again = [b for b in narrow if "place" in b]
        for place in sorted({b["place"] for b in again}):
            part = [b for b in again if b.get("place") == place]
            rows = with_brackets(part).where(inside).select(*own, "i", "__v").groupBy(*by, "i").agg(_bracket(F.col("__v"), place).alias("b")).collect()
            new = {(tuple(r[c] for c in by), r["i"]): r["b"] for r in rows}
            for b in part:
                b["lo"], b["hi"] = new[b["g"], b["i"]]
                del b["place"]
        open_ = narrow
    if open_:
        raise RuntimeError("brackets don't narrow")
    if not done:
        nothing = [F.lit(None).cast("double").alias(f"q{i}") for i in range(len(qs))]
        return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, "n", *nothing)
    ranks = spark.createDataFrame([(*b["g"], b["i"], b["n"], b["k"] - b["below"], (b["n"] - 1) * qs[b["i"]] - b["k"]) for b in done], ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "i int, n long, k long, part double"]))
    inside = (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))
    values = with_brackets(done).where(inside).select(*own, "i", "__v").groupBy(*by, "i", "__v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("upto", upto).alias("v").join(F.broadcast(ranks).alias("r"), reduce(Column.__and__, [F.col(f"v.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], F.col("v.i") == F.col("r.i")))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("__v")))
    found = values.groupBy(*[F.col(f"r.{c}").alias(c) for c in by], F.col("r.i").alias("i"), "n", "part").agg(at(F.col("k")).alias("a"), at(F.col("k") + 1).alias("b"))
    found = found.select(*by, "i", "n", F.when(F.col("part") > 0, F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).otherwise(F.col("a")).alias("q"))
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(qs))])
