"""Closes of zero: the change after one is infinite or NaN, as in the SQL, and no error."""

import datetime as dt

import duckdb
import pytest

from tessera.plans import registry
from tests.test_queries import rows


@pytest.mark.parametrize("name", ["w19_exact_labels"])
def test_close_of_zero(spark, tmp_path, name):
    values = {1: [5.0, 0.0, 4.0, 2.0], 2: [0.0, 0.0, 0.0, 3.0], 3: [1.0, 2.0, 0.0, 0.0], 4: [3.0, 3.0, None, 6.0]}
    events = [(100 * u + i, dt.datetime(2024, 1, 1 + i), u, "view", v, "{}") for u, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(registry.SQL[name])
    assert rows(map(tuple, got.select(*[x[0] for x in want.description]).collect())) == rows(want.fetchall())
