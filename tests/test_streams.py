"""Streams cut into one and many micro-batches, with rows out of order, restarts and replayed batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import ops, state

@pytest.fixture(autouse=True)
def one_state_store(spark):
    """Two keys need no more."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SCHEMA = "id long, ts timestamp, key string, v double"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def events(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, START + datetime.timedelta(minutes=10 * i + rng.randint(0, 9)), rng.choice("aab"), rng.choice([None, 1.0, 2.0, 70.0, 90.0])) for i in range(n)]


def feed(spark, rows, folder, closing=None):
    """One more file of the stream."""
    if closing:
        rows = [*rows, (None, closing, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def cut(rows, n, seed=2):
    """Arrival in n batches: each row up to 20 rows late, shuffled within its batch."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[0] + (rng.randint(0, 20) if n > 1 else 0))
    parts = [late[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]
    for p in parts:
        rng.shuffle(p)
    return parts


def kept(out):
    return sorted(map(tuple, out.collect()), key=repr)


def twins(rows):
    """What the three operators give, by plain loops."""
    held, streak, gates = [], [], []
    for key in sorted({r[2] for r in rows}):
        last, n, runs = None, 0, (None, 0, False)
        for i, _, _, v in sorted((r for r in rows if r[2] == key), key=lambda r: (r[1], r[0])):
            last, source = (v, "live") if v is not None else (last, "held" if last is not None else "missing")
            held.append((key, i, last, source))
            n = n + 1 if v == 1.0 else 0
            streak.append((key, i, n))
            raw = "risk" if (v or 0) > 60 else "normal"
            length = runs[1] + 1 if runs[0] == raw else 1
            runs = (raw, length, raw == "risk" if length >= 2 else runs[2])
            gates.append((key, i, raw, "risk" if runs[2] else "caution" if raw == "risk" else raw))
    return [sorted(x, key=repr) for x in (held, streak, gates)]


@pytest.mark.parametrize(("batches", "restart"), [(1, False), (20, True)])
def test_keyed_state_is_the_same_for_any_batches(spark, tmp_path, batches, restart):
    rows = events()
    parts, folder, want = cut(rows, batches), str(tmp_path / "in"), twins(rows)
    closing = START + datetime.timedelta(days=30)

    def outputs(name):
        s = ops.event_stream(spark, folder, "*.parquet", SCHEMA, files=1).withWatermark("ts", "6 hours")
        raw = F.when(F.coalesce("v", F.lit(0.0)) > 60, F.lit("risk")).otherwise(F.lit("normal"))
        kind = F.when(F.col("v") == 1.0, F.lit("error")).otherwise(F.lit("ok"))
        streams = [ops.hold_last(s, "key", ["ts", "id", "v"]), ops.failure_streak(s.withColumn("kind", kind), "key", ["ts", "id", "kind"], "error"), ops.gate(s.withColumn("raw", raw), "key", ["ts", "id", "raw"], 2, 2)]
        return [kept(ops.run_to_table(x, str(tmp_path / f"out{i}"), str(tmp_path / f"check{i}"))) for i, x in enumerate(streams)]

    for k, part in enumerate(parts):
        feed(spark, part, folder, closing if k == batches - 1 else None)
        if restart and k == batches // 2:
            half = outputs("half")  # the queries end here and go on from their checkpoints
            assert all(0 < len(h) < len(w) and set(h) <= set(w) for h, w in zip(half, want, strict=True))
    assert outputs("all") == want


def silences(rows, stale, stalled, end):
    out = []
    for key in {r[2] for r in rows}:
        times = sorted(int(r[1].timestamp() * 1000) for r in rows if r[2] == key)
        for a, b in zip(times, [*times[1:], None]):
            gap = (b or end) - a
            out += [(key, a, a + stale, "feed_stale")] * (gap > stale) + [(key, a, a + stalled, "stalled")] * (gap > stalled)
            out += [(key, a, b, "OK")] * (b is not None and gap > stale)
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 12])
def test_silent_keys_are_reported_by_timers(spark, tmp_path, batches):
    rows = [r for r in events(200, seed=5) if not (r[2] == "b" and 40 < r[0] < 160)] + [(-1, START, "gone", 1.0)]
    folder, parts = str(tmp_path / "in"), cut(rows, batches)
    (tmp_path / "in").mkdir()
    s = ops.event_stream(spark, folder, "*.parquet", SCHEMA, files=1).withWatermark("ts", "6 hours")
    watched = state.watch(s, "key", ["ts", "id"], 3600, 4 * 3600)

    def seen():
        return kept(ops.run_to_table(watched, str(tmp_path / "out"), str(tmp_path / "check")))

    for k, part in enumerate(parts):
        feed(spark, part, folder)
        if k == batches - 3 + 2 * (batches == 1):
            early = seen()
            assert {x[3] for x in early if x[0] == "gone"} == {"feed_stale", "stalled"}  # others' rows moved the time on
    feed(spark, [], folder, START + datetime.timedelta(days=10, hours=6))
    want = silences(rows, 3_600_000, 4 * 3_600_000, int((START + datetime.timedelta(days=10)).timestamp() * 1000))
    assert seen() == want
    assert seen() == want  # a restart with nothing new emits nothing twice


def test_sinks_are_the_same_after_a_replay(spark, tmp_path):
    rows = [(i, START + datetime.timedelta(hours=h), k, float(i)) for i, (h, k) in enumerate([(9.2, "a"), (9.1, "a"), (9.3, "b"), (12, "a"), (20, "b"), (9.05, "a"), (33.2, "a"), (33.1, "b"), (9.0, "b")])]
    path = str(tmp_path / "sinks")
    write = ops.into_sinks(path, "key", "ts", "id", "09:00:00", "09:25:59", "15:00:00")
    frames = [spark.createDataFrame(rows[a:b], SCHEMA) for a, b in ((0, 5), (5, 9))]
    ids = lambda sink: sorted(r["id"] for r in spark.read.parquet(f"{path}/{sink}").collect())
    write(frames[0], 0)
    first = [ids(s) for s in ops.SINKS]
    assert first == [[1, 2], [0, 3], [4]]
    write(frames[0], 0)  # replayed
    assert [ids(s) for s in ops.SINKS] == first
    write(frames[1], 1)
    after = [ids(s) for s in ops.SINKS]
    assert after == [[1, 2, 6, 7], [0, 3, 5, 8], [4]]  # rows 5 and 8 are earlier in the window, but the day was frozen
    write(frames[1], 1)
    write(frames[0], 0)
    assert [ids(s) for s in ops.SINKS] == after


def test_append_above_mark_survives_a_failure_between_its_writes(spark, tmp_path, monkeypatch):
    rows = [[(1, 1, "a"), (2, 2, "a"), (3, 5, "b")], [(2, 2, "a"), (4, 1, "a"), (5, 3, "a"), (5, 3, "a"), (6, 4, "b"), (7, 1, "c")], [(8, 3, "a"), (9, 9, "b"), (7, 1, "c")]]
    frames = [spark.createDataFrame([(i, START + datetime.timedelta(days=t), k, 0.0) for i, t, k in part], SCHEMA) for part in rows]
    path = str(tmp_path / "t")
    write = ops.append_above_mark(path, "key", "ts", ["id"])
    write(frames[0], 0)
    put = ops.put_batch

    def failing(df, at, batch):
        if at.endswith("marks"):
            raise RuntimeError("lost")
        put(df, at, batch)

    monkeypatch.setattr(ops, "put_batch", failing)
    with pytest.raises(RuntimeError):
        write(frames[1], 1)
    monkeypatch.setattr(ops, "put_batch", put)
    for f, b in ((frames[1], 1), (frames[1], 1), (frames[2], 2), (frames[2], 2)):
        write(f, b)
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/rows").collect()) == [1, 2, 3, 5, 7, 9]


def test_a_stream_that_fails_in_a_batch_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = events(60)
    folder, path = str(tmp_path / "in"), str(tmp_path / "t")
    for part in cut(rows, 4):
        feed(spark, part, folder)
    write, failed = ops.append_above_mark(path, "key", "ts", ["id"]), []

    def once(df, batch):
        write(df, batch)
        if batch == 2 and not failed:
            failed.append(batch)
            raise RuntimeError("the driver is lost after the batch was written")

    stream = lambda: ops.event_stream(spark, folder, "*.parquet", SCHEMA, files=1)
    with pytest.raises(Exception, match="lost"):
        ops.run_batches(stream(), once, str(tmp_path / "check"))
    ops.run_batches(stream(), once, str(tmp_path / "check"))
    marks, want = {}, []
    for part in cut(rows, 4):
        want += [r[0] for r in part if r[2] not in marks or r[1] > marks[r[2]]]
        for r in part:
            marks[r[2]] = max(marks.get(r[2], r[1]), r[1])
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/rows").collect()) == sorted(want) and failed == [2]
