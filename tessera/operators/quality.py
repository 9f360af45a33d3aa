"""Data quality: profiles, structural checks, coverage, ledgers and manifests, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_stats(df: DataFrame, date: str, keys: list[str], null_cols: list[str]) -> DataFrame:
    """One row: rows, last day, share of nulls, share of rows that repeat a key."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"__c_{c}") for c in null_cols], F.max(date).alias("__d"))
    n = F.sum("__n")
    return dup.agg(n.alias("rows"), F.max("__d").alias("last_day"), *[(1 - F.sum(f"__c_{c}") / n).alias(f"null_{c}") for c in null_cols], (1 - F.count(F.lit(1)) / n).alias("duplicate_share"))


def integrity(df: DataFrame, date: str, key: str, numbers: list[str], most: float) -> DataFrame:
    """One row: counts, nulls, negatives and extremes of each number, range of dates, distinct keys."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"), F.countDistinct(key).alias("keys")]
    for c in numbers:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.col(c) < 0).alias(f"{c}_negative"), F.count_if(F.abs(c) > most).alias(f"{c}_extreme")]
    return df.agg(*aggs)


def key_coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in both, in the left only, in the right only."""
    x = a.select(*keys).distinct().withColumn("__l", F.lit(1)).join(b.select(*keys).distinct().withColumn("__r", F.lit(1)), keys, "full_outer")
    return x.agg(F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("common"), F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"))


def bar_errors(tol: float = 1e-6) -> Column:
    """Names of the structural rules that a daily bar breaks."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    core = F.greatest(*[x.isNull() for x in (o, h, lo, c)])
    found = F.array(
        F.when(core, F.lit("null_core")), F.when(F.least(o, h, lo, c) <= 0, F.lit("price")), F.when((h + tol < F.greatest(o, lo, c)) | (lo - tol > F.least(o, h, c)), F.lit("ohlc")),
        F.when((F.col("volume") < 0) | (F.col("amount") < 0), F.lit("negative")),
    )
    return F.filter(found, lambda e: e.isNotNull())


def validate_bars(bars: DataFrame) -> DataFrame:
    """One row: rows, bad rows (each counted once) and rows by rule."""
    x = bars.withColumn("__e", bar_errors())
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("__e") > 0).alias("bad"), *[F.count_if(F.array_contains("__e", k)).alias(k) for k in ("null_core", "price", "ohlc", "negative")])


def gaps(calendar: DataFrame, loaded: DataFrame, date: str = "date") -> DataFrame:
    """Sessions of the calendar that didn't land."""
    return calendar.select(date).distinct().join(loaded.select(date).distinct(), date, "left_anti")


def coverage_by_symbol(bars: DataFrame, sessions: int) -> DataFrame:
    return bars.groupBy("symbol").agg(F.countDistinct("date").alias("days"), (F.countDistinct("date") / sessions).alias("coverage"))


def backfill_plan(source_day: str, watermark: str, expected: str, strength: str, calendar: DataFrame, date: str = "date") -> DataFrame:
    """(action, reason, day): the missing sessions, or one row that names why nothing is to be done."""
    spark = calendar.sparkSession
    if strength != "official":
        refusal = "calendar_not_official"
    elif watermark >= expected:
        refusal = "store_current"
    elif source_day >= expected:
        refusal = "source_current"
    else:
        days = calendar.where((F.col(date) > F.lit(watermark)) & (F.col(date) <= F.lit(expected)))
        return days.select(F.lit("backfill").alias("action"), F.lit("both_behind").alias("reason"), F.col(date).cast("date").alias("day")).distinct()
    return spark.createDataFrame([("refuse", refusal, None)], "action string, reason string, day date")


def approximate_fill(missing: DataFrame, pit: DataFrame) -> DataFrame:
    """Price to book and cap of (symbol, date) rows that the valuation lacks, from the report and shares known then."""
    x = missing.join(pit, ["symbol", "date"])
    return x.select("symbol", "date", F.when(F.col("bvps") > 0, F.col("close") / F.col("bvps")).alias("pb"), (F.col("close") * F.col("float_shares")).alias("cap"), F.lit("approx").alias("source"))


def chain_hash(prev: Column, payload: Column) -> Column:
    """Hash of the hash before and the payload; a null payload is none, not an empty one."""
    return F.sha2(F.concat(prev, F.when(payload.isNull(), F.lit("")).otherwise(F.concat(F.lit("|"), payload))).cast("binary"), 256)


def verify_chain(ledger: DataFrame, head: int | None = None) -> DataFrame:
    """(ledger, rows, broken, first_bad): link to the row before, own hash, and the number of rows if it is known.

    Rows without a hash before the chain begins are allowed."""
    w = Window.partitionBy("ledger").orderBy("seq")
    x = ledger.withColumns({"__before": F.lag("hash").over(w), "__began": F.count("hash").over(w)})
    link = F.when(F.col("__before").isNull(), F.lit(True)).otherwise(F.col("prev").eqNullSafe(F.col("__before")))
    own = F.col("hash").eqNullSafe(chain_hash(F.coalesce("prev", F.lit("")), F.col("payload")))
    bad = F.when(F.col("__began") == 0, F.lit(False)).otherwise(~link | ~own)
    out = x.groupBy("ledger").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("broken"), F.min(F.when(bad, F.col("seq"))).alias("first_bad"))
    return out if head is None else out.withColumn("broken", F.col("broken") + F.when(F.col("rows") == head, 0).otherwise(1))


def build_chain(rows: DataFrame) -> DataFrame:
    """Hashes a ledger (ledger, seq, payload) in order: each row's hash covers the one before.

    Ledgers are dealt out and sorted by Spark and hashed as they stream by; a task holds one hash, however long a ledger is."""
    import hashlib

    def run(batches):
        ledger, prev = object(), ""
        for pdf in batches:
            prevs, hashes = [], []
            for own, payload in zip(pdf["ledger"], pdf["payload"], strict=True):
                own = None if own != own else own  # null comes as NaN in a column of numbers
                if own != ledger:
                    ledger, prev = own, ""
                prevs.append(prev)
                prev = hashlib.sha256((prev if payload is None or payload != payload else f"{prev}|{payload}").encode()).hexdigest()
                hashes.append(prev)
            yield pdf.assign(prev=prevs, hash=hashes)

    k = dict(rows.dtypes)
    dealt = rows.select("ledger", "seq", "payload").repartition("ledger").sortWithinPartitions("ledger", "seq")
    return dealt.mapInPandas(run, f"ledger {k['ledger']}, seq {k['seq']}, payload string, prev string, hash string")


def manifest_of(spark, folder: str, name: Column | None = None) -> DataFrame:
    """(name, sha256) of the files under a folder; ``name`` is made from ``path``, by default its last part."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select((F.element_at(F.split("path", "/"), -1) if name is None else name).alias("name"), F.sha2("content", 256).alias("sha256")).where("name is not null")


def verify_manifest(spark, folder: str, manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """(name, status) of files in a folder against a manifest of (name, sha256): ok, changed, missing or extra."""
    x = manifest.join(manifest_of(spark, folder, name).withColumnRenamed("sha256", "__have"), "name", "full_outer")
    return x.select("name", F.when(F.col("__have").isNull(), F.lit("missing")).when(F.col("sha256").isNull(), F.lit("extra")).when(F.col("sha256") == F.col("__have"), F.lit("ok")).otherwise(F.lit("changed")).alias("status"))


def boundary_profile(df: DataFrame, value: str, source: str = "source", date: str = "date") -> DataFrame:
    return df.groupBy(date, source).agg(F.count(F.lit(1)).alias("rows"), (F.count(value) / F.count(F.lit(1))).alias("coverage"), F.median(value).alias("median"))


def worklist(df: DataFrame, value: str, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """Rows whose value is missing, counted by symbol with their first and last day."""
    return df.where(F.col(value).isNull()).groupBy(symbol).agg(F.count(F.lit(1)).alias("missing"), F.min(date).alias("first"), F.max(date).alias("last"))


def rebuild_day(source: DataFrame, target: DataFrame, least_rows: int, times: float = 100.0, key: str = "symbol") -> DataFrame:
    """Authoritative rows, plus the target's own rows that it lacks with ``turnover`` rescaled; a thin source is an error."""
    n = source.count()
    if n < least_rows:
        raise ValueError(f"the source has {n} rows; {least_rows} are needed")
    rest = target.join(source.select(key), key, "left_anti").withColumn("turnover", F.col("turnover") * times)
    return source.unionByName(rest.select(*source.columns))


def rebuild_dimension(listing: DataFrame, least_rows: int, code: str = "code") -> DataFrame:
    """Six-digit codes, once each, with their market by prefix; a thin listing is an error."""
    x = listing.where(F.col(code).rlike(r"^\d{6}$")).dropDuplicates([code])
    n = x.count()
    if n < least_rows:
        raise ValueError(f"the listing has {n} codes; {least_rows} are needed")
    return x.withColumn("market", F.when(F.col(code).startswith("6"), F.lit("SH")).when(F.col(code).startswith("4") | F.col(code).startswith("8"), F.lit("BJ")).otherwise(F.lit("SZ")))


def settle(stored: DataFrame, labels: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Fills labels that have matured; settled ones stay, so a second run changes nothing."""
    y = labels.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in cols])
    x = stored.join(y, keys, "left")
    return x.select(*[F.coalesce(F.col(c), F.col(f"__new_{c}")).alias(c) if c in cols else F.col(c) for c in stored.columns])
