"""Overlap of parts that must come in order: state for each stream with a timer that ends it, and parts out of order refused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "user_id long, kind string, event_id long, value double"


def joined_parts(at: np.ndarray, ids: np.ndarray, values: np.ndarray, last: tuple[int, int, float] | None, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, float] | None]:
    """(kind, id, value) of a stream's new parts in order of (at, ids), and the last part after them.

    A part that isn't behind the last one is refused. A part gap or more behind the one before it, or without one, primes with its own value; any other
    is lapped, its value added to that of the one before. Behind these come the parts that a priming one has ended (flush).
    """
    order = np.lexsort((ids, at))
    at, ids, values = at[order], ids[order], values[order]
    late = np.zeros(len(at), bool) if last is None else (at < last[0]) | ((at == last[0]) & (ids <= last[1]))
    late[1:] |= (at[1:] == at[:-1]) & (ids[1:] == ids[:-1])  # the same part once more
    kept = ~late
    t, v = at[kept], values[kept]
    before_t, before_v = np.concatenate(([last[0] if last else 0], t[:-1])), np.concatenate(([last[2] if last else 0.0], v[:-1]))
    primes = t - before_t >= gap
    if last is None and len(t):
        primes[0] = True
    kind = np.full(len(at), "refused", object)
    kind[kept] = np.where(primes, "prime", "lap")
    out = values.copy()
    out[kept] = np.where(primes, v, v + before_v)
    first = np.concatenate(([last[1] if last else 0], ids[kept][:-1]))
    ended = np.flatnonzero(primes & (np.arange(len(t)) + (last is not None) > 0))
    kind, all_ids, out = np.concatenate((kind, np.full(len(ended), "flush", object))), np.concatenate((ids, first[ended])), np.concatenate((out, before_v[ended]))
    if len(t):
        last = (int(t[-1]), int(ids[kept][-1]), float(v[-1]))
    return kind, all_ids, out, last


class OrderedLap(StatefulProcessor):
    """State is a user's last part. Its timer, gap behind it, writes it out (flush) and clears the state, so that silent users hold none."""

    def __init__(self, gap_seconds: int) -> None:
        self.gap = gap_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, event_id long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p[["at", "event_id", "value"]].dropna() for p in rows]  # three numbers a row of one user in one micro-batch
        new = pd.concat(parts)
        if not len(new):
            return
        held = self.last.get() if self.last.exists() else None
        kind, ids, value, last = joined_parts(new["at"].to_numpy(np.int64), new["event_id"].to_numpy(np.int64), new["value"].to_numpy(np.float64), held and tuple(held), self.gap)
        if last is not None:
            self.last.update(last)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last[0] + self.gap)
        yield pd.DataFrame({"user_id": key[0], "kind": kind, "event_id": ids, "value": value})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at, event_id, value = self.last.get()
            if at + self.gap <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield pd.DataFrame({"user_id": [key[0]], "kind": ["flush"], "event_id": [event_id], "value": [value]})

    def close(self) -> None:
        pass


def ordered_lap(events: DataFrame, gap_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(user_id, kind, event_id, value) of a stream of events (user_id, ts, event_id, value): one row for each event with a value, and one when a user's state ends.

    Rows of a micro-batch go by (ts, event_id). What comes at or before a user's last event is refused and told; it changes nothing. A micro-batch's
    rows of one user are ordered in memory, so its size is to be bounded where it is read (maxFilesPerTrigger).
    """
    rows = events.withWatermark("ts", delay).select("user_id", "ts", F.unix_millis("ts").alias("at"), "event_id", "value")
    return rows.groupBy("user_id").transformWithStateInPandas(OrderedLap(gap_seconds), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def run_ordered(spark: SparkSession, events: DataFrame, gap_seconds: int, place: str) -> DataFrame:
    """Run ordered_lap over all that is there now; its rows, written to a folder. The state store has to be RocksDB while the stream starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = ordered_lap(events, gap_seconds)
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
