"""A registry of open entries, kept in a stream's state and swept by timers.

An entry opens with the first event of its key, later events of the key update it, and the first sweep
at which it is older than its time to live evicts it; the key's next event opens a new one. Sweeps come
at whole multiples of a period of event time. Events may come in any order within the watermark's
delay: they wait in the state until the watermark has passed the sweep that ends their entry.

Keys share buckets, whose events lie in the state as packed frames with the bucket's next sweep: a call
of the state serves many keys at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.plans.shared import shared_path
from tidewater.sources.fixtures import table

#: An entry's time to live and the sweeps' period, in seconds.
LIVES, PERIOD = 11 * 60, 600
#: Buckets of keys, and events in a packed frame.
BUCKETS, FRAME_ROWS = 256, 10_000
#: The provider of a state that has timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVICTED = "key long, opened timestamp_ntz, evicted timestamp_ntz, n_events long, last_status string"
_OUT = "key long, opened long, evicted long, n_events long, last_status string"
_PACKED = pa.schema([("key", pa.int64()), ("us", pa.int64()), ("id", pa.int64()), ("status", pa.string())])


def sweep_after(opened_ms: int, lives: int, period: int) -> int:
    """The first sweep, in milliseconds, at which an entry is older than its time to live."""
    return ((opened_ms + lives * 1000) // (period * 1000) + 1) * period * 1000


def _pack(events: pa.Table) -> list[tuple[bytes]]:
    frames = []
    for start in range(0, events.num_rows, FRAME_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _PACKED) as out:
            out.write_table(events.slice(start, FRAME_ROWS))
        frames.append((sink.getvalue().to_pybytes(),))
    return frames


class Registry(StatefulProcessor):
    """Per bucket the events that no sweep has passed yet, and the first sweep that evicts one of its entries."""

    def __init__(self, lives: int, period: int):
        self.lives, self.period = lives, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frame binary")
        self.next = handle.getValueState("next", "sweep long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, earliest = [], None
        for batch in rows:
            if len(batch):
                frames += _pack(pa.Table.from_pandas(batch[_PACKED.names], _PACKED, preserve_index=False))
                earliest = min(x for x in (earliest, int(batch["us"].min())) if x is not None)
        if frames:
            self.waiting.appendList(frames)
            sweep, held = sweep_after(earliest // 1000, self.lives, self.period), self.next.get()
            if held is None or sweep < held[0]:
                self.next.update((sweep,))
                self.handle.registerTimer(sweep)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Evicts all entries whose sweep the watermark has passed; the next one's sweep gets a timer."""
        now, held = timerValues.getCurrentWatermarkInMs(), self.next.get()
        if held is None or held[0] > now:  # a timer that an earlier event has overtaken
            return
        events = pa.concat_tables([pa.ipc.open_stream(bytes(f[0])).read_all() for f in self.waiting.get()])
        keys, times, ids = (events.column(c).to_numpy() for c in ("key", "us", "id"))
        events = events.take(pa.array(np.lexsort((ids, times, keys))))
        keys, status = events.column("key").to_numpy(), events.column("status").combine_chunks()
        times = events.column("us").to_pylist()
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist()
        out, left, sweeps = [], np.zeros(len(keys), bool), []
        for at, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            own = int(keys[at])
            while at < end:
                sweep = sweep_after(times[at] // 1000, self.lives, self.period)
                if sweep > now:
                    left[at:end] = True
                    sweeps.append(sweep)
                    break
                last = bisect_left(times, sweep * 1000, at, end)
                out.append((own, times[at], sweep * 1000, last - at, status[last - 1].as_py()))
                at = last
        if sweeps:
            self.waiting.put(_pack(events.filter(pa.array(left))))
            self.next.update((min(sweeps),))
            self.handle.registerTimer(min(sweeps))
        else:
            self.waiting.clear()
            self.next.clear()
        yield pd.DataFrame(out, columns=["key", "opened", "evicted", "n_events", "last_status"])

    def close(self) -> None:
        pass


def evictions(events: DataFrame, lives: int = LIVES, period: int = PERIOD, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """The entries that sweeps evict, of a stream of events (key, id, ts, status): key, when it opened and
    was evicted, its events, and the status of the last one (of several at one time, the largest id's).
    An event more than `delay` behind the latest may come too late. Events without key or time are
    left out; one without id counts as -1. A stream's state keeps to its number of buckets."""
    rows = events.filter(F.col("key").isNotNull() & F.col("ts").isNotNull()).select(
        F.col("key").cast("long").alias("key"),
        F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "status",
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    swept = rows.withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(Registry(lives, period), _OUT, "Append", "EventTime")
    when = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return swept.select("key", when("opened"), when("evicted"), "n_events", "last_status")


def run(
    spark: SparkSession,
    events: DataFrame,
    sink: str,
    checkpoint: str,
    lives: int = LIVES,
    period: int = PERIOD,
    delay: str = "1 minute",
    buckets: int = BUCKETS,
    partitions: int | None = None,
) -> None:
    """Appends the evictions of all that the stream holds now to the folder `sink`. A later run with the
    same checkpoint, and as many buckets, goes on with the entries that are still open. The first run
    may say how many partitions the state has."""
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = evictions(events, lives, period, delay, buckets).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        out.outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: The query's entries live a day and are swept each hour: a user's events are hours apart.
QUERY_LIVES, QUERY_PERIOD = 86_400, 3_600
#: Events that a bucket of the query's keys holds about.
BUCKET_EVENTS = 10_000


def q_registry_evictions(spark: SparkSession, d: str) -> DataFrame:
    """Entries by user over the events as a stream; such as are still open at its end are not evicted."""
    stored = table(spark, d, "events")
    shape, buckets = stored.schema, max(BUCKETS, stored.count() // BUCKET_EVENTS)
    events = spark.readStream.schema(shape).parquet(f"{d}/event[s].parquet")  # a stream takes folders and patterns
    entries = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("status"))
    sink = shared_path(spark, "evictions")
    state, partitions = shared_path(spark, "evictions-state"), 4 * spark.sparkContext.defaultParallelism
    run(spark, entries, sink, state, QUERY_LIVES, QUERY_PERIOD, buckets=buckets, partitions=partitions)
    return spark.read.schema(EVICTED).parquet(sink).withColumnRenamed("key", "user_id")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
_SWEEP = f"make_timestamp(CAST(((epoch_ms({{t}}) + {QUERY_LIVES * 1000}) // {QUERY_PERIOD * 1000} + 1) * {QUERY_PERIOD * 1_000_000} AS BIGINT))"
ORACLES = {
    "registry_evictions": f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, event_type FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
entry AS (
  SELECT user_id, min(ts) AS opened, {_SWEEP.format(t="min(ts)")} AS evicted FROM e GROUP BY user_id
  UNION ALL
  SELECT n.user_id, n.opened, {_SWEEP.format(t="n.opened")} FROM (SELECT entry.user_id, min(e.ts) AS opened FROM entry JOIN e ON e.user_id = entry.user_id AND e.ts >= entry.evicted GROUP BY entry.user_id) n
)
SELECT user_id, opened, evicted, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS last_status FROM entry JOIN e USING (user_id)
WHERE e.ts >= opened AND e.ts < evicted AND evicted <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events) GROUP BY ALL"""
}
