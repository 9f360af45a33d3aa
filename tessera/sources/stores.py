"""Reading and writing panel tables: versions, monotone and idempotent appends, upserts, day replacement, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path has data, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_merged(spark: SparkSession, paths: list[str] | str, columns: dict[str, str]) -> DataFrame:
    """Parquet with merged schemas, reduced to the given columns; one that no file has is null."""
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def write_version(df: DataFrame, path: str, tag: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/version={tag}")


def read_version(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={tag}")


def append_days(df: DataFrame, path: str, date: str = "date") -> int:
    """Appends whole days that the table lacks and that aren't before its last day; returns the rows appended."""
    spark = df.sparkSession
    if exists(spark, path):
        have = spark.read.parquet(path)
        days = have.select(date).distinct()
        top = have.agg(F.max(date).alias("__top"))
        df = df.crossJoin(F.broadcast(top)).where(F.col("__top").isNull() | (F.col(date) >= F.col("__top"))).drop("__top").join(days, date, "left_anti")
    return _append(df, path)


def append_absent(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the table lacks."""
    spark = df.sparkSession
    df = df.dropDuplicates(keys)
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    return _append(df, path)


def _append(df: DataFrame, path: str) -> int:
    """Counts what it writes on the way, in one pass."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(seen.get["n"])


def upsert(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new rows replaced those of their keys; of new rows with one key the last by ``__order`` wins, columns are aligned."""
    order = new.withColumn("__o", F.col("__order") if "__order" in new.columns else F.monotonically_increasing_id()).drop("__order")
    both = have.withColumn("__o", F.lit(-1).cast("long")).unionByName(order, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__o"))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").select(*have.columns)


def replace_days(df: DataFrame, path: str, date: str = "date") -> None:
    """Writes whole day partitions over those of the same days; other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def above_watermark(new: DataFrame, have: DataFrame, key: str = "symbol", date: str = "date") -> DataFrame:
    """Rows later than their key's last one in the table; keys that it lacks pass whole."""
    marks = have.groupBy(key).agg(F.max(date).alias("__wm"))
    return new.join(marks, key, "left").where(F.col("__wm").isNull() | (F.col(date) > F.col("__wm"))).drop("__wm")


def recompute_window(have: DataFrame, fresh: DataFrame, start, date: str = "day") -> DataFrame:
    """Rows before ``start`` as they are, later ones from the recomputed table, one for each day."""
    return have.where(F.col(date) < F.lit(start)).unionByName(fresh.where(F.col(date) >= F.lit(start)).dropDuplicates([date]))


def merge_snapshot(have: DataFrame, snap: DataFrame, day, keys: list[str], date: str = "date") -> DataFrame:
    """History with a snapshot's rows added as one day's, none of the day's own replaced."""
    rows = snap.withColumn(date, F.lit(day).cast(dict(have.dtypes)[date]))
    return have.unionByName(rows.join(have.select(*keys, date), [*keys, date], "left_anti").select(*have.columns))


def normalize(df: DataFrame, spec: dict[str, dict], keys: list[str], least_rows: int = 1, order: str | None = None) -> DataFrame:
    """Rows in the panel's shape by a declared field map: source column, multiplier, date format, code or number.

    The last row of a key wins; days with fewer rows than ``least_rows`` are left out."""
    from tessera.functions import scalar as S

    cols = []
    for name, s in spec.items():
        c = F.col(s["from"])
        if s.get("kind") == "code":
            c = S.canonical_code(c)
        elif s.get("kind") == "date":
            c = S.norm_date(c)
        else:
            c = c.cast("string").try_cast("double") * s.get("times", 1.0)
        cols.append(c.alias(name))
    x = df.select(*cols, (F.col(order) if order else F.monotonically_increasing_id()).alias("__o"))
    x = x.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__o")))).where("__k = 1").drop("__k", "__o")
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return x.withColumn("__n", n).where(F.col("__n") >= least_rows).drop("__n")


def read_ledger(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a JSON-lines ledger: a line that can't be parsed is kept as text, not fatal."""
    from pyspark.sql.types import StringType, StructType, _parse_datatype_string

    full = StructType([*_parse_datatype_string(schema).fields]).add("_bad", StringType())
    raw = spark.read.text(path)
    parsed = raw.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null and r is not null").select("r.*").drop("_bad"), parsed.where("r._bad is not null").select(F.col("value").alias("line"))


def write_views(views: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each view as Parquet and returns (view, rows), counted while writing."""
    out = [(name, _append_view(df, f"{path}/{name}")) for name, df in views.items()]
    return next(iter(views.values())).sparkSession.createDataFrame(out, "view string, rows long")


def _append_view(df: DataFrame, path: str) -> int:
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return int(seen.get["n"])
