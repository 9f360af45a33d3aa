"""Tables that are changed by key: copy-on-write over hash buckets, made visible by one manifest.

A table is a folder with data folders, each written once, and numbered manifests that name the folder of each bucket.  An upsert
reads and rewrites the buckets that its keys fall into, and nothing else; the next manifest, put in place by one rename,
makes them visible.  Until then, and after a failure, readers see the table as it was; folders that no manifest names can be
deleted by ``vacuum``.  One writer at a time: a second that began from the same manifest fails at the swap."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.stores import above_watermark, upsert

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number and content of the latest manifest: keys, number of buckets, schema and the folder of each bucket that has rows."""
    versions = sorted(int(n.split(".")[0]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json"))
    if not versions:
        raise FileNotFoundError(path)
    text = spark.read.text(f"{path}/manifests/{versions[-1]}.json", wholetext=True).first()[0]
    return versions[-1], json.loads(text)


def publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Puts a manifest in place: written under another name, then renamed."""
    fs, folder = _fs(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    draft, final = (_fs(spark, f"{path}/manifests/{n}")[1] for n in (f"{uuid.uuid4().hex}.draft", f"{version}.json"))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {version} was written by another")


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _write(df: DataFrame, path: str, keys: list[str], n: int) -> tuple[str, list[int]]:
    """Writes rows into a new data folder, a subfolder for each bucket; its name and the buckets that have rows."""
    name = uuid.uuid4().hex
    x = df.withColumn("__bucket", _bucket(keys, n)).repartition("__bucket")
    x.write.partitionBy("__bucket").parquet(f"{path}/data/{name}")
    return name, [int(b.split("=")[1]) for b in _names(df.sparkSession, f"{path}/data/{name}") if b.startswith("__bucket=")]


def create(df: DataFrame, path: str, keys: list[str], by: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """A table of rows that ``keys`` name, dealt to buckets by ``by``, some of the keys (by default all)."""
    by = by or keys
    name, have = _write(df, path, by, buckets)
    publish(df.sparkSession, path, 1, {"keys": keys, "by": by, "buckets": buckets, "schema": df.schema.json(), "folders": {str(b): name for b in have}})


def _read(spark: SparkSession, path: str, m: dict, buckets: list[int] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(m["schema"]))
    at = [f"{path}/data/{name}/__bucket={b}" for b, name in sorted(m["folders"].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as its latest manifest has it; a reader's files stay when the table changes."""
    return _read(spark, path, manifest(spark, path)[1])


def merge(new: DataFrame, path: str) -> int:
    """Upserts rows by the table's keys (the last by ``__order`` wins, columns are aligned) and returns the new version.

    The driver gets the numbers of the touched buckets, at most as many as there are."""
    from tessera.sources.scratch import written

    spark = new.sparkSession
    version, m = manifest(spark, path)
    by, n = m["by"], m["buckets"]
    new = written(new)
    touched = sorted(r[0] for r in new.select(_bucket(by, n).alias("b")).distinct().collect())
    if not touched:
        return version
    name, have = _write(upsert(_read(spark, path, m, touched), new, m["keys"]), path, by, n)
    publish(spark, path, version + 1, m | {"folders": m["folders"] | {str(b): name for b in have}})
    return version + 1


def repair(source: DataFrame, path: str, key: str, date: str) -> DataFrame:
    """Writes the source's rows that are later than their key's last one in the table, and returns them."""
    from tessera.sources.scratch import written

    late = written(above_watermark(source, read(source.sparkSession, path), key, date))
    merge(late, path)
    return late


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes data folders that the latest manifest doesn't name, and older manifests; no reader may still use them."""
    version, m = manifest(spark, path)
    gone = [n for n in _names(spark, f"{path}/data") if n not in set(m["folders"].values())]
    for at in [*(f"{path}/data/{n}" for n in gone), *(f"{path}/manifests/{n}" for n in _names(spark, f"{path}/manifests") if n != f"{version}.json")]:
        fs, p = _fs(spark, at)
        fs.delete(p, True)
    return gone
