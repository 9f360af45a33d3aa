"""Mixing sources to target weights.

Method: words are summed for each source, targets follow from the weights (what is above ``cap`` times a source's size is
dealt again to the others), and each source's repetition rate is its target by its size.  A document is taken floor(rate)
times, plus one copy if the hash of its id under a seed falls below the fraction.

Defined results: a null text has size 0; a null source is a source of its own, the last; a source without words has
target 0 and rate 0; rows that repeat an id share their hash, so they are taken alike, and reruns agree; an empty table
gives an empty table; a text is counted whole, whatever its length; other columns are passed on, by ``mixture`` whatever
their names and types.  The table of sources is sorted in one task: it has a row for each source, whatever the number of
documents, and a hot source is summed where its rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialize, pack, unpack

SEED = "mix-1"
#: The table of sources is broadcast up to so many rows, so that no text is shuffled; beyond, Spark chooses the join.
BROADCAST_ROWS = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_: Column, seed: str = SEED) -> Column:
    """A number from 0 to under 1 that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from a table of sources and sizes.

    Sources are capped in the order of cap by weight: with k of them capped, each other one gets its weight's part of the
    rest; the first k that leaves all others under their caps is the fixed point of dealing the excess again."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    t = sizes.withColumn("w", w)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(whole)
    t = t.withColumn("level", (total - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    fits = F.col("level") * F.col("w") <= F.lit(cap) * F.col("source_size")
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("final", level)
    # null: every source is capped
    return t.select("source", "source_size", F.least(F.coalesce(F.col("final") * F.col("w"), F.lit(cap) * F.col("source_size")), F.lit(cap) * F.col("source_size")).alias("target"))


MADE = ("__size", "__source", "__source_size", "__target", "__copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """All rows with ``__size``, ``__source_size``, ``__target`` and ``__copies``, the number of times the mix takes them; columns
    of these names that the rows had are replaced."""
    own = docs.drop(*MADE).select("*", size_of(F.col(text_col)).alias("__size"))
    sums = own.groupBy(F.col(source_col).alias("source")).agg(F.sum("__size").alias("source_size"))
    rates = materialize(targets(sums, weights, share, cap).select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")))
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    own = own.join(rates, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    copies = F.floor(rate) + (draw(F.col(id_col), seed) < rate - F.floor(rate)).cast("long")
    return own.withColumn("__copies", copies)


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*columns)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, each as often as it does, with their columns as they are."""
    used = [id_col, text_col, source_col]
    packed = pack(docs, used)
    return unpack(emit(mix(packed, id_col=id_col, text_col=text_col, source_col=source_col, **options), packed.columns), docs.columns, used)
