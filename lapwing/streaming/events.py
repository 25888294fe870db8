"""Structured Streaming over events: hopping energies, sessions, and overlap-add with state for each stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with ts as an instant."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    found = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    whole = spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles()
    folder = whole[0].rsplit("/", 1)[0]
    if folder.endswith("events.parquet"):
        return found.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, place: str) -> DataFrame:
    """Run a stream over all that is there now, its rows written to a folder, and read them."""
    spark = stream.sparkSession
    if mode == "complete":
        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{place}/out")

        query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def hop_energy(events: DataFrame, size: str = "2 hours", hop: str = "1 hour") -> DataFrame:
    """(start, event_type, n, energy) over hopping windows; batch or stream."""
    events = events.withWatermark("ts", "10 minutes") if events.isStreaming else events
    of = events.groupBy(F.window("ts", size, hop), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("energy"))
    return of.select(F.col("window.start").alias("start"), "event_type", "n", "energy")


def sessions(events: DataFrame, gap: str = "4 hours") -> DataFrame:
    """(user_id, start, n, total): events of a user less than a gap apart; batch or stream."""
    events = events.withWatermark("ts", "10 minutes") if events.isStreaming else events
    of = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return of.select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def lap(events: DataFrame) -> DataFrame:
    """(user_id, lapped, sum): each value added to the one before it of its user, in the order of arrival; the first only primes.

    State is a user's last value. Within a micro-batch rows go by (ts, event_id).
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, total = state.get if state.exists else (None, 0, 0.0)
        # neighbours' sums are twice the sum of all, less the first and the last; so only these are kept while parts pass by
        first_at, last_at, first, end, count, every = None, None, None, None, 0, 0.0
        for part in parts:
            part = part[part.value.notna()]
            if not len(part):
                continue
            order = part.sort_values(["ts", "event_id"])
            low, high = order.iloc[0], order.iloc[-1]
            if first_at is None or (low.ts, low.event_id) < first_at:
                first_at, first = (low.ts, low.event_id), float(low.value)
            if last_at is None or (high.ts, high.event_id) > last_at:
                last_at, end = (high.ts, high.event_id), float(high.value)
            count, every = count + len(part), every + float(part.value.sum())
        if count:
            n += count - (last is None)
            total += 2 * every - end - first + (0.0 if last is None else last + first)
            last = end
        state.update((last, n, total))
        yield pd.DataFrame({"user_id": [key[0]], "lapped": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, lapped long, total double", "last double, n long, total double", "update", GroupStateTimeout.NoTimeout)
