"""Labels half way between two rounded ones: logarithms, their order and the rounding are those of the SQL."""

import datetime as dt

import duckdb

from tessera.plans import registry
from tests.test_queries import rows

NAME = "w19_exact_labels"


def test_labels_half_way(spark, tmp_path):
    # 27.27 / 6.4 - 1 is 3.2609375 and 68.24 / 10.24 - 1 is 5.6640625
    values = {1: [21.18, 6.4, 11.27, 27.73, 27.27], 2: [29.65, 8.61, 10.24, 68.24, 25.95]}
    events = [(100 * u + i, dt.datetime(2024, 1, 1 + i), u, "view", v, "{}") for u, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = registry.QUERIES[NAME](spark, str(tmp_path))
    want = con.execute(registry.SQL[NAME])
    assert rows(map(tuple, got.select(*[x[0] for x in want.description]).collect())) == rows(want.fetchall())
