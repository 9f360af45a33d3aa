"""SimHash near-duplicates by covering locality-sensitive hashing.

Method: with radius r, each of the 64 bits gets a non-zero vector of r + 1 bits and each of the 2^(r+1) - 1 non-zero
vectors v makes a table whose mask keeps the bits whose vector has an odd product with v.  The vectors of r differing bits
span at most r of r + 1 dimensions, so some v is orthogonal to them all: its mask keeps none of them, and every pair
within the radius collides in that table (Pagh, "Locality-sensitive hashing without false negatives", 2016).

Fingerprints that collide are confirmed without pairs: a fingerprint sends itself under every value within r/2 bits, of
the bits its collisions leave free; two that meet at such a value are within the radius, and two within the radius meet
half way.  At most 65 fingerprints meet at one value for a radius of 2, so no group is hot.  Components come from labels
spread over these meetings, with the labels' own labels followed each round.

Defined results: a null or empty text has fingerprint zero, linked like any other; a text of fewer words than a shingle is
one shingle; equal fingerprints are one class however many rows have them; rows that repeat an id repeat its result; a
null id counts as no id in the minimum and its row gets its class's component; a text is read whole, whatever its length;
columns beside the id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, last_folder, mark, materialize, sweep

SEED = 42
BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), SEED)
    hashes = np.array([h(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id_col, fp long)``: the fingerprint's bits as a signed number."""

    def run(cols):
        return {id_col: cols[id_col], "fp": np.array([fingerprint(t, shingle) for t in cols[text_col]], "<u8").view("<i8")}

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


def masks(radius: int) -> list[int]:
    """The structured masks; the non-zero vectors are dealt to the bits in turn."""
    n = 1 << (radius + 1)
    return [sum(1 << bit for bit in range(BITS) if bin((bit % (n - 1) + 1) & v).count("1") & 1) for v in range(1, n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``(fp, to)`` edges between distinct fingerprints that join all that are within the radius, through a star at each
    meeting value; ``fps`` has distinct values of ``fp``.  The radius is even."""
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in tables])).alias("t", "key"))
    full = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key")
    met = keyed.join(materialize(full), ["t", "key"], "left_semi")
    # the bits left free by any of a fingerprint's collisions
    free_mask = F.element_at(F.array(*[F.lit(signed(~m & ((1 << 64) - 1))) for m in tables]), F.col("t") + 1)
    candidates = materialize(met.groupBy("fp").agg(F.bit_or(free_mask).alias("free")))
    bit = [F.lit(signed(1 << b)) for b in range(BITS)]
    values: Column = F.array(F.lit(0).cast("long"))
    for _ in range(radius // 2):
        values = F.array_distinct(F.flatten(F.transform(values, lambda v: F.concat(F.array(v), F.transform(F.array(*bit), lambda b: v.bitwiseXOR(b))))))
    near = candidates.select("fp", F.explode(F.filter(values, lambda v: v.bitwiseAND(F.col("free")) == v)).alias("v")).select("fp", F.col("fp").bitwiseXOR(F.col("v")).alias("at"))
    # at most 65 meet at a value for a radius of 2
    stars = near.groupBy("at").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return stars.select(F.explode("all").alias("fp"), F.array_min("all").alias("to")).where("fp <> to").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(fp, label)``: the least fingerprint reachable, for each fingerprint that has an edge.

    Each round takes the least label among the neighbours and then the label of that label; rows are summed before each
    shuffle and each round ends in a table in the shared folder."""
    spark = edges.sparkSession
    both = materialize(edges.select("fp", "to").union(edges.select("to", "fp")).distinct())
    start = mark()
    labels = materialize(both.groupBy("fp").agg(F.min("to").alias("m")).select("fp", F.least("fp", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("fp").alias("to"), "label"), "to").groupBy("fp").agg(F.min("label").alias("m"))
        step = materialize(labels.join(near, "fp").select("fp", F.least("label", "m").alias("label"), F.col("label").alias("old")))
        jump = step.select(F.col("fp").alias("label"), F.col("label").alias("next"))
        new = materialize(step.join(jump, "label").select("fp", F.col("next").alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        sweep(spark, start, but=(last_folder(),))  # the tables of the rounds before aren't read any more
        if not changed:
            return new.select("fp", "label")
        labels = new.select("fp", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(id_col, fp, component_id)`` for each row: the least id of the rows whose fingerprints are reachable."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle))
    classes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("first")))
    labels = components(links(classes.select("fp"), radius))
    named = classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    owner = materialize(named.join(least, "label").select("fp", "component_id"))
    return rows.join(owner, "fp").select(id_col, "fp", "component_id")
