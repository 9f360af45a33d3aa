"""Keys share buckets of state: state calls are per bucket and batch, and each key's rows still go through in order."""

from types import SimpleNamespace

from tessera.streaming import state


class Store:
    """List and value state and timers of one bucket, with the number of calls."""

    def __init__(self):
        self.lists, self.value, self.timers, self.calls = [], None, set(), 0

    def getListState(self, name, schema):
        def change(values):
            self.calls, self.lists = self.calls + 1, values

        return SimpleNamespace(appendValue=lambda v: change([*self.lists, v]), put=change, clear=lambda: change([]), get=lambda: iter(self.lists))

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def at(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def test_many_keys_of_a_bucket_take_one_value_of_state():
    store, p = Store(), state.InOrder((0,), lambda s, r: ((s[0] + 1,), [(r[1], s[0] + 1)]), ["key", "id", "n"])
    p.init(store)
    rows = [(7, k, 1000 * (9 - t), 10 * k + t) for k in range(500) for t in range(5)] + [(7, None, 1, 1), (7, 3, None, 1), (7, 3, 1, None)]
    list(p.handleInputRows((7,), iter(rows), at(0)))
    assert store.calls == 2 and len(store.lists) == 1  # one append and one timer for 500 keys
    out = [tuple(r) for r in p.handleExpiredTimer((7,), at(7000), None)]
    assert sorted(out) == sorted((k, 10 * k + t, n) for k in range(500) for n, t in enumerate((4, 3, 2), 1))
    assert 8000 in store.timers
    rest = [tuple(r) for r in p.handleExpiredTimer((7,), at(10_000), None)]
    assert sorted(rest) == sorted((k, 10 * k + t, n) for k in range(500) for n, t in enumerate((1, 0), 4)) and not store.lists


def test_a_silent_keys_timer_leaves_the_timer_of_rows_that_wait():
    quiet = lambda s, now: (s, [], 5000 if now < 5000 else None)
    store, p = Store(), state.InOrder((0,), lambda s, r: ((1,), []), ["key"], quiet)
    p.init(store)
    list(p.handleInputRows((7,), iter([(7, 1, 1000, 1), (7, 2, 9000, 2)]), at(0)))
    store.timers.clear()
    list(p.handleExpiredTimer((7,), at(1000), None))
    assert store.timers == {5000}
    list(p.handleExpiredTimer((7,), at(5000), None))
    assert 9000 in store.timers


def test_a_replay_reads_its_table_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming import ops

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def read(k):
        seen.add(1)
        return k

    df = spark.range(60).select(read("id").alias("id"), F.timestamp_seconds("id").alias("ts"))
    ops.replay(df, F.pmod("id", F.lit(4)).cast("int"), 4, str(tmp_path / "arrivals"), "2030-01-01 00:00:00")
    files = sorted((tmp_path / "arrivals").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == 4 and seen.value <= 120  # once for the rows, at most once more for their slices
    got = [sorted(r["id"] for r in spark.read.parquet(str(f)).collect() if r["id"] is not None) for f in files]
    assert got == [list(range(i, 60, 4)) for i in range(4)]
