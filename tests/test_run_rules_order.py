"""The mean of an indicator is summed in order of date, whatever the order of its rows."""

import datetime as dt

from tessera.operators import statistics


def test_means_are_summed_by_date(spark):
    values = [(1, 1e16), (3, -1e16), (2, 1.0), *((k, 0.0) for k in range(4, 13))]  # by date 1e16 takes the 1 up, and the mean is 0
    df = spark.createDataFrame([("a", dt.date(2024, 1, k), v) for k, v in values], "indicator string, date date, value double").coalesce(1)
    got = {r["date"].day: r["same_side_9"] for r in statistics.we_rules(df).collect()}
    assert not got[12]
