"""Rank IC of huge groups and of their parts: equal to ranks in one task, ties spread, few jobs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ic, research


@pytest.fixture
def tied(spark):
    rng = random.Random(8)
    rows = [("f" if i % 5 else "g", 1 + i * 3 // 6000, float(rng.randint(-5000, 5000)) if i % 7 else math.nan, 0.0 if rng.random() < 0.5 else rng.choice([1.0, -0.0, rng.random(), None])) for i in range(6000)]
    return spark.createDataFrame(rows, "factor string, part int, value double, label double").repartition(8)


def table(df):
    return {(r["factor"], r["part"]): (r["n"], r["status"], round(r["ic"], 12)) for r in df.collect()}


def test_parts_and_whole_equal_ranks_in_one_task(tied):
    want = table(ic.rank_ic(tied.withColumn("part", F.lit(0)), ["factor", "part"])) | table(ic.rank_ic(tied, ["factor", "part"]))
    assert table(ic.parted_rank_ic(tied, ["factor"], "part")) == want and len(want) == 8
    assert ic.parted_rank_ic(tied.limit(0), ["factor"], "part").count() == 0


def test_few_rows_and_one_value(spark):
    df = spark.createDataFrame([("f", 1 + i // 5, float(i), 2.0 if i < 5 else float(-i)) for i in range(10)], "factor string, part int, value double, label double")
    got = {r["part"]: (r["n"], r["status"]) for r in ic.parted_rank_ic(df, ["factor"], "part").collect()}
    assert got == {0: (10, "insufficient_pairs"), 1: (5, "constant_rank"), 2: (5, "settled")}


def test_evidence_runs_few_jobs(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(f"d{i % 9}", f"s{i:03}", f, rng.random(), rng.random()) for i in range(300) for f in "xy"], "date string, symbol string, factor string, value double, label double")
    sc = spark.sparkContext
    sc.setJobGroup("evidence", "evidence")
    try:
        assert research.evidence(df, 4, 5).count() == 2
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("evidence"))
    print("jobs", jobs)
    assert jobs <= 35
