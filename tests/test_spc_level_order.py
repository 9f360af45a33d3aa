"""The level of an indicator whose values lie on its mean is that of the mean in order of date, whatever the order of its rows."""

import datetime as dt
import random

from tessera.operators import statistics


def test_levels_are_those_of_sums_by_date(spark):
    values = [(1, 1e16), (3, -1e16), (2, 1.0), *((k, 0.0) for k in range(4, 13))]  # by date 1e16 takes the 1 up, the mean is 0 and no run of nine lies below it
    for seed in (None, 1, 2):
        rows = list(values)
        if seed is not None:
            random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([("a", dt.date(2024, 1, k), v) for k, v in rows], "indicator string, date date, value double").coalesce(1)
        got = {r["date"].day: r["level"] for r in statistics.spc_level(df, 6.0).collect()}
        assert len(got) == 12 and got[12] == "OK"
