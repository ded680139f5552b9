"""The registry of open entries: timers, order, and a restart from its checkpoint."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from tidewater.streaming import registry

SHAPE = "key long, id long, ts timestamp_ntz, status string"
START = datetime(2024, 1, 1)


def plain(events, lives, period, end):
    """Entries by one walk over each key's events in order."""
    out, by_key = [], {}
    for k, i, ts, s in events:
        if k is not None and ts is not None:
            by_key.setdefault(k, []).append((ts, -1 if i is None else i, s))
    for k, own in by_key.items():
        own.sort(key=lambda e: e[:2])
        while own:
            age = (own[0][0] - START).total_seconds() + lives
            sweep = START + timedelta(seconds=(int(age) // period + 1) * period)
            if sweep > end:
                break
            entry = [e for e in own if e[0] < sweep]
            out.append((k, own[0][0], sweep, len(entry), entry[-1][2]))
            own = own[len(entry) :]
    return sorted(out)


def made(n=300, keys=6, hours=10):
    rng = random.Random(4)
    rows = [(rng.randrange(keys), i, START + timedelta(seconds=rng.randrange(hours * 3600), microseconds=rng.randrange(10**6)), f"s{i % 3}") for i in range(n)]
    return sorted(rows, key=lambda r: r[2])


def got(spark, sink):
    return sorted(tuple(r) for r in spark.read.schema(registry.EVICTED).parquet(sink).collect())


@pytest.fixture
def folders(tmp_path):
    return [f"file://{tmp_path}/{x}" for x in ("in", "out", "state")]


def stream(spark, folder):
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(folder)


def test_evictions_in_several_runs(spark, folders):
    """Events come in four lots, out of order within each; the second run opens the state of the first."""
    source, sink, state = folders
    events, rng = made(), random.Random(1)
    hours = [[e for e in events if lo <= e[2] < hi] for lo, hi in ((START + timedelta(hours=a), START + timedelta(hours=b)) for a, b in ((0, 2), (2, 5), (5, 6), (6, 10)))]
    seen = []
    for lot in hours:
        rng.shuffle(lot)
        spark.createDataFrame(lot, SHAPE).coalesce(1).write.mode("append").parquet(source)
        seen += lot
        registry.run(spark, stream(spark, source), sink, state, 1500, 600)
        end = max(e[2] for e in seen) - timedelta(minutes=1)
        assert got(spark, sink) == plain(seen, 1500, 600, end) != []


def test_a_failed_run_is_repeated(spark, folders, monkeypatch):
    source, sink, state = folders
    events = made(120)
    half = len(events) // 2
    spark.createDataFrame(events[:half], SHAPE).coalesce(1).write.parquet(source)
    registry.run(spark, stream(spark, source), sink, state, 1500, 600)
    before = got(spark, sink)
    spark.createDataFrame(events[half:], SHAPE).coalesce(1).write.mode("append").parquet(source)
    broken = stream(spark, source).selectExpr("key", "id", "ts", f"CASE WHEN id = {events[-1][1]} THEN raise_error('broken off') ELSE status END AS status")
    with pytest.raises(Exception, match="broken off"):
        registry.run(spark, broken, sink, state, 1500, 600)
    assert got(spark, sink) == before
    registry.run(spark, stream(spark, source), sink, state, 1500, 600)
    assert got(spark, sink) == plain(events, 1500, 600, events[-1][2] - timedelta(minutes=1)) and len(got(spark, sink)) > len(before)


def test_odd_events(spark, folders):
    source, sink, state = folders
    at = lambda s: START + timedelta(seconds=s)
    events = [(1, 1, at(0), "a"), (1, 1, at(0), "a"), (1, 2, at(0), None), (None, 3, at(1), "x"), (2, None, at(5), None), (2, 4, None, "y"), (1, 5, at(1200), "exactly at the sweep"), (3, 6, at(9999), "last")]
    spark.createDataFrame(events, SHAPE).coalesce(1).write.parquet(source)
    registry.run(spark, stream(spark, source), sink, state, 660, 600)
    assert got(spark, sink) == [(1, at(0), at(1200), 3, None), (1, at(1200), at(2400), 1, "exactly at the sweep"), (2, at(5), at(1200), 1, None)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != registry.PROVIDER


class Held:
    """A state's value or list, and the calls that it took."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return self.rows

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def appendList(self, rows):
        self.put([*self.rows, *rows])

    def clear(self):
        self.put([])


class One(Held):
    def get(self):
        return super().get() or None

    def update(self, row):
        self.put(row)


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getListState(self, name, shape):
        return self.states.setdefault(name, Held())

    def getValueState(self, name, shape):
        return self.states.setdefault(name, One())

    def registerTimer(self, at):
        self.timers.add(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_of_the_state_dont_grow_with_the_keys():
    """A bucket of 400 keys takes as many calls of the state and timers as one key; evicted is the same."""
    epoch, calls = datetime(1970, 1, 1), []
    us = lambda t: (t - epoch) // timedelta(microseconds=1)
    for keys in (1, 400):
        events, handle, box = made(2000, keys), Handle(), registry.Registry(1500, 600)
        box.init(handle)
        box.handleInputRows((0,), iter([pd.DataFrame([(k, i, us(t), s) for k, i, t, s in events], columns=["key", "id", "us", "status"])]), None)
        first, end = set(handle.timers), START + timedelta(hours=8)
        out = [tuple(r) for f in box.handleExpiredTimer((0,), Now(us(end) // 1000), None) for r in f.itertuples(index=False)]
        assert sorted(out) == [(k, us(a), us(b) // 1000 * 1000, n, s) for k, a, b, n, s in plain(events, 1500, 600, end)] != []
        assert list(box.handleExpiredTimer((0,), Now(us(end) // 1000), None)) == [] and len(first) == 1 and len(handle.timers) == 2
        calls.append(sum(x.calls for x in handle.states.values()))
    assert calls[0] == calls[1]


def test_any_number_of_buckets(spark, tmp_path):
    events = made(600, 40)
    source = f"file://{tmp_path}/in"
    spark.createDataFrame(events, SHAPE).coalesce(1).write.parquet(source)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for buckets in (1, 7):
        sink = f"file://{tmp_path}/out{buckets}"
        registry.run(spark, stream(spark, source), sink, f"file://{tmp_path}/state{buckets}", 1500, 600, buckets=buckets, partitions=2)
        assert got(spark, sink) == plain(events, 1500, 600, events[-1][2] - timedelta(minutes=1)) != []
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
