"""Exponential means as scans over blocks against the recursion, on long and sparse histories."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import windows

DAY = datetime.date(2001, 1, 1)


def history(n, step, seed):
    rng = np.random.default_rng(seed)
    days = np.cumsum(rng.integers(1, step + 1, n))
    close = 20 + np.cumsum(rng.normal(0, 0.3, n)) ** 2 / 50
    return pd.DataFrame({"date": [DAY + datetime.timedelta(int(d)) for d in days], "high": close + 0.5, "low": close - 0.4, "close": close})


def recursion(p):
    c, h, lo = p["close"], p["high"], p["low"]
    d = c.diff()
    up, down = (x.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean() for x in (d, -d))
    dif = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    dea = dif.ewm(span=9, adjust=False).mean()
    return pd.DataFrame({"rsi": 100 - 100 / (1 + up / down.where(down != 0)), "dif": dif, "dea": dea, "macd": 2 * (dif - dea), "atr": tr.ewm(alpha=1 / 14, adjust=False).mean()})


@pytest.mark.parametrize(("n", "step"), [(4000, 1), (900, 3), (300, 200), (1, 1)])
def test_technical_equals_the_recursion_over_many_blocks(spark, n, step):
    p = history(n, step, n)
    df = spark.createDataFrame(p.assign(symbol="hot")).unionByName(spark.createDataFrame(p.head(3).assign(symbol="few")))
    got = windows.technical(df.repartition(5)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    for symbol, q in (("hot", p), ("few", p.head(3))):
        want, mine = recursion(q), got[got["symbol"] == symbol]
        for c in want:
            np.testing.assert_allclose(mine[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_a_long_history_is_many_tasks_work_without_pandas(spark):
    df = spark.createDataFrame(history(4000, 1, 1).assign(symbol="hot"))
    plan = windows.technical(df)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = windows.in_blocks(df, "close").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(rows) > 1 and max(r["count"] for r in rows) < 4000
