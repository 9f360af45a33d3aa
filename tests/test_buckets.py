"""Tables changed by key: untouched files stay, failures and races change nothing."""

import os

import pytest

from tessera.sources import buckets

SCHEMA = "symbol string, day int, v int"


def files(path, m):
    return {b: {f: os.stat(f"{path}/data/{n}/__bucket={b}/{f}").st_mtime_ns for f in os.listdir(f"{path}/data/{n}/__bucket={b}") if f.endswith(".parquet")} for b, n in m["folders"].items()}


def rows(spark, path):
    return sorted(map(tuple, buckets.read(spark, path).collect()))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    have = sorted((f"s{i}", d, i * 10 + d) for i in range(30) for d in range(3))
    buckets.create(spark.createDataFrame(have, SCHEMA), path, ["symbol", "day"], ["symbol"], 8)
    assert rows(spark, path) == have and buckets.manifest(spark, path)[0] == 1
    before, early = files(path, buckets.manifest(spark, path)[1]), buckets.read(spark, path)
    new = spark.createDataFrame([("s3", 1, -1, 1), ("s3", 1, -2, 2), ("s3", 9, -3, 1)], SCHEMA + ", __order int")
    assert buckets.merge(new, path) == 2
    want = sorted({(s, d): (s, d, v) for s, d, v in [*have, ("s3", 1, -2), ("s3", 9, -3)]}.values())
    assert rows(spark, path) == want and sorted(map(tuple, early.collect())) == have
    after = files(path, buckets.manifest(spark, path)[1])
    assert sum(after[b] != before[b] for b in before) == 1  # other files keep their names and times
    assert len(buckets.vacuum(spark, path)) == 0 and rows(spark, path) == want  # the first folder is still in use
    assert buckets.merge(new.limit(0), path) == 2


def test_a_failure_before_the_swap_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    have = [("a", 1, 1), ("b", 1, 2)]
    buckets.create(spark.createDataFrame(have, SCHEMA), path, ["symbol", "day"], None, 4)
    new = spark.createDataFrame([("a", 1, 5), ("c", 1, 6)], SCHEMA)
    publish = buckets.publish

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(buckets, "publish", lost)
    with pytest.raises(RuntimeError, match="lost"):
        buckets.merge(new, path)
    monkeypatch.setattr(buckets, "publish", publish)
    assert rows(spark, path) == have
    assert len(buckets.vacuum(spark, path)) == 1  # what the failed attempt wrote
    buckets.merge(new, path)
    assert rows(spark, path) == [("a", 1, 5), ("b", 1, 2), ("c", 1, 6)]
    with pytest.raises(RuntimeError, match="another"):
        buckets.publish(spark, path, 2, {})  # a writer that began from the version before


def test_repair_writes_rows_above_the_marks(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 3)], SCHEMA), path, ["symbol", "day"], ["symbol"], 4)
    source = spark.createDataFrame([("a", 1, 9), ("a", 3, 4), ("b", 5, 9), ("b", 4, 9), ("c", 1, 7)], SCHEMA)
    assert sorted(map(tuple, buckets.repair(source, path, "symbol", "day").collect())) == [("a", 3, 4), ("c", 1, 7)]
    assert rows(spark, path) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 4), ("b", 5, 3), ("c", 1, 7)]
    assert buckets.repair(source, path, "symbol", "day").count() == 0
