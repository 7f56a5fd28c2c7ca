"""Reinforcement with keyed state: what a memory has become is kept by its id, so no micro-batch reads the memories.

The state of a memory is its sector, salience, when it was last seen and its hits so far,
and the events of the last while, so that one that comes again counts once. Events are forgotten by
event-time timers once no repetition of them can pass the watermark. The state begins
with the stored memories; those that come later arrive by the same stream
as rows with a sector and no event. State lives in RocksDB under the query's
checkpoint: it may outgrow memory, and a restarted query goes on where it stopped.

Defined cases: hits may come in any order and again; hits later than the
watermark, of no memory, or without an event id or a time are dropped; a memory that comes again
keeps its state; a memory of an unknown sector does not decay; a null salience counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import constants as C

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How late a hit may come, in minutes.
LATENESS = 10
DAY = 86_400_000_000
OUTPUT = "id string, hits long, new_salience double, last_seen_at long"


def step(sector: str | None, salience: float, idle_days: float) -> float:
    """A salience after one hit that comes so many days after the memory was last seen."""
    if sector in C.DECAY_RATES:
        left = math.exp(-C.DECAY_RATES[sector] * idle_days)
        salience = min(1.0, max(0.0, salience * left + C.FLOOR_SALIENCE * (1.0 - left)))
    return min(1.0, salience + (1.0 - salience) * C.TRACE_RATE + C.HIT_BONUS)


class Reinforcement(StatefulProcessor):
    """Rows (id, event_id, at, primary_sector, salience, last_seen_at), times in microseconds. ``as_of``: the time of every hit, else its own."""

    def __init__(self, as_of: int | None = None, lateness: int = LATENESS) -> None:
        self.as_of, self.lateness = as_of, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "sector string, salience double, seen long, hits long")
        self.events = handle.getMapState("events", "event_id string", "until long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.begin(next(initialState.itertuples()))

    def begin(self, row) -> None:
        if not self.memory.exists():
            salience = 0.0 if pd.isna(row.salience) else float(row.salience)
            self.memory.update((row.primary_sector, salience, None if pd.isna(row.last_seen_at) else int(row.last_seen_at), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)  # one key's rows of one micro-batch
        for row in batch[batch["event_id"].isna()].itertuples():
            if isinstance(row.primary_sector, str):
                self.begin(row)
        in_time = batch["at"] >= timerValues.getCurrentWatermarkInMs() * 1000  # false for a hit without a time
        hits = batch[batch["event_id"].notna() & in_time].drop_duplicates("event_id").sort_values(["at", "event_id"])
        if self.memory.exists() and len(hits):
            sector, salience, seen, n = self.memory.get()
            before = n
            for row in hits.itertuples():
                if self.events.containsKey((row.event_id,)):
                    continue
                until = int(row.at) // 1000 + self.lateness * 60_000
                self.events.updateValue((row.event_id,), (until,))
                self.handle.registerTimer(until)
                now = int(row.at) if self.as_of is None else self.as_of
                salience = step(sector, salience, 0.0 if seen is None else max(0.0, (now - seen) / DAY))
                seen, n = max(now, seen or now), n + 1
            if n > before:
                self.memory.update((sector, salience, seen, n))
                yield pd.DataFrame({"id": [key[0]], "hits": [n], "new_salience": [salience], "last_seen_at": [seen]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for name in [k for k, (until,) in self.events.iterator() if until <= now]:
            self.events.removeKey(name)
        return iter(())


def _micros(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.unix_micros(F.col(column).cast("timestamp")))


def reinforced(hits: DataFrame, memories: DataFrame, as_of: int | None = None, lateness: int = LATENESS) -> DataFrame:
    """The stream of reinforced memories (id, hits so far, new_salience, last_seen_at): a row for each memory and micro-batch with new hits.

    ``hits`` is a stream of memory_id, event_id and ts, and may have primary_sector, salience and
    last_seen_at for rows that are new memories; ``memories`` (id, primary_sector, salience,
    last_seen_at) is read once, when the state begins. ``as_of``, in microseconds, is taken for the time of every hit.
    """
    late = hits.withWatermark("ts", f"{lateness} minutes")
    extra = {c: F.lit(None).cast(t) for c, t in (("primary_sector", "string"), ("salience", "double"), ("last_seen_at", "timestamp")) if c not in hits.columns}
    rows = _micros(late.withColumns(extra), "last_seen_at").select(F.col("memory_id").alias("id"), F.col("event_id").cast("string").alias("event_id"), "ts", F.unix_micros("ts").alias("at"), "primary_sector", "salience", "last_seen_at")
    first = _micros(memories.select("id", "primary_sector", "salience", "last_seen_at"), "last_seen_at").dropDuplicates(["id"])
    out = rows.where("id IS NOT NULL").groupBy("id").transformWithStateInPandas(Reinforcement(as_of, lateness), OUTPUT, outputMode="Update", timeMode="EventTime", initialState=first.where("id IS NOT NULL").groupBy("id"))
    return out.withColumn("last_seen_at", F.timestamp_micros("last_seen_at"))


def start(df: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Run the stream over what is there now; ``sink`` gets each batch and its number. The query keeps its state in RocksDB, whatever the session's provider is."""
    spark: SparkSession = df.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return df.writeStream.foreachBatch(lambda batch, number: sink(number, batch)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
