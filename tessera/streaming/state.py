"""Keyed state in event-time order: rows wait in the state store until the watermark has passed them.

Micro-batches cut a stream where they like and rows come out of order, so an operator that depends on order may not act on
a row before no earlier one can come.  ``in_order`` keeps rows as list state, sets a timer at the earliest and, when the
watermark has passed it, lets each key's rows through in order of (time, id) with a few numbers of state.  Python's state calls
cost about a millisecond, so keys share ``BUCKETS`` state keys by their hash, and calls are per bucket and batch, not per key;
a bucket's waiting rows and states are all that a task holds at a time.
Results are therefore the same for any cut into batches, any order within the watermark's delay and any restart from the checkpoint.
``watch`` sets further timers after a key's last row and reports keys that have fallen silent without a row of their own.

Both need the RocksDB state store, which ``run`` in ``tessera.streaming.ops`` chooses: state is on disk and a checkpoint holds changes only."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Buckets of keys; a task holds the waiting rows and states of one.
BUCKETS = 1024

Step = Callable[[tuple, tuple], tuple[tuple, list[tuple]]]


class InOrder(StatefulProcessor):
    """Rows ``(key, time in ms, id, values...)`` of a bucket of keys through ``step(state, row) -> (state, rows out)``, each key's in
    order of time and id; ``step`` sees rows without the key.

    ``quiet(state, now)`` gives the state and rows when the watermark comes to ``now`` and the time of the next call, or None."""

    def __init__(self, start: tuple, step: Step, names: list[str], quiet: Callable | None = None):
        self.start, self.step, self.names, self.quiet = start, step, names, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.held = handle.getValueState("held", "packed binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # rows without a key, time or id only move the watermark; a filter in the plan would go below it and take them away
        new = [tuple(r)[1:] for r in rows]  # without the bucket
        new = [r for r in new if None not in r[:3]]
        if new:
            self.waiting.appendValue((pickle.dumps(new, -1),))  # one value of state for a batch's rows
            self.handle.registerTimer(min(r[1] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, late = [], []
        for (packed,) in self.waiting.get():
            for r in pickle.loads(packed):
                (ready if r[1] <= now else late).append(r)
        ready.sort(key=lambda r: r[1:3])
        before = pickle.loads(packed[0]) if (packed := self.held.get()) is not None else {}
        held, out = dict(before), []
        for k, *row in ready:
            held[k], made = self.step(held.get(k, self.start), tuple(row))
            out += [(k, *o) for o in made]
        timers = {min(r[1] for r in late)} if late else set()
        if self.quiet:
            for k, state in held.items():
                held[k], made, again = self.quiet(state, now)
                out += [(k, *o) for o in made]
                if again is not None:
                    timers.add(again)
        if ready:
            self.waiting.put([(pickle.dumps(late, -1),)]) if late else self.waiting.clear()
        if held != before:
            self.held.update((pickle.dumps(held, -1),))
        if timers:
            self.handle.registerTimer(min(timers))  # which sets the next one
        make = Row(*self.names)
        for o in out:
            yield make(*o)

    def close(self) -> None:
        pass


def _processed(stream: DataFrame, key: str, cols: list[str], out: str, start: tuple, step: Step, quiet: Callable | None = None) -> DataFrame:
    """``stream`` has a watermark on ``cols[0]``; ``cols`` are the time, an id that breaks ties, and values."""
    kinds = dict(stream.dtypes)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("__bucket")
    x = stream.select(bucket, F.col(key), F.unix_millis(cols[0]).alias("__ms"), *[F.col(c) for c in cols[1:]])
    names = [key, *[o.strip().split(" ")[0] for o in out.split(",")]]
    return x.groupBy("__bucket").transformWithState(InOrder(start, step, names, quiet), f"{key} {kinds[key]}, {out}", "Append", "EventTime")


def in_order(stream: DataFrame, key: str, cols: list[str], out: str, held: str, start: tuple, step: Step) -> DataFrame:
    """``(key, out...)``: the rows of each key through ``step`` in order of ``cols[:2]``, its time and id; ``held`` names the
    state's fields and ``start`` is its value before the first row."""
    return _processed(stream, key, cols, out, start, step)


def watch(stream: DataFrame, key: str, cols: list[str], stale_s: int, stalled_s: int) -> DataFrame:
    """``(key, last_ms, at_ms, status)``: ``feed_stale`` and then ``stalled`` when a key has been silent for longer than the two
    times, and ``OK`` when it is heard again.

    Silence is measured by the watermark, which the other keys' rows move on, and reported by a timer."""
    levels = (("feed_stale", stale_s * 1000), ("stalled", stalled_s * 1000))

    def reached(state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        """What silence until ``now`` has come to; a timer stands one millisecond beyond the time."""
        last, level = state
        out = []
        while last is not None and level < len(levels) and now - last > levels[level][1]:
            out.append((last, last + levels[level][1], levels[level][0]))
            level += 1
        return (last, level), out

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (last, level), out = reached(state, row[0])
        if level:
            out.append((last, row[0], "OK"))
        return (row[0], 0), out

    def quiet(state: tuple, now: int) -> tuple[tuple, list[tuple], int | None]:
        (last, level), out = reached(state, now)
        return (last, level), out, last + levels[level][1] + 1 if last is not None and level < len(levels) else None

    return _processed(stream, key, cols, "last_ms long, at_ms long, status string", (None, 0), step, quiet)
