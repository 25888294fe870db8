"""Queries that run events as a stream, to their end, and return what the stream holds then."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.streaming import events, ordered

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; one of its own only where none is named in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="lapwing-stream-")


@query("""
with h as (select event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start from events)
select start, event_type, count(*) as n, round(sum(value * value), 6) as energy from h group by start, event_type""")
def stream_hop_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy over windows of two hours at hops of one."""
    of = events.drained(events.hop_energy(events.event_stream(spark, sf_dir)), "complete", _place(spark))
    return of.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("energy", 6).alias("energy"))


@query("""
with g as (select *, case when ts >= lag(ts) over w + interval 4 hours or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, four hours apart at least."""
    of = events.drained(events.sessions(events.event_stream(spark, sf_dir)), "complete", _place(spark))
    return of.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""
select user_id, count(*) - 1 as lapped, round(2 * sum(value) - min_by(value, (ts, event_id)) - max_by(value, (ts, event_id)), 4) + 0 as total from events group by user_id""")
def stream_lap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value added to the one before: with state for each user."""
    place = _place(spark)
    stream = events.lap(events.event_stream(spark, sf_dir))

    def write(batch: DataFrame, k: int) -> None:
        batch.write.parquet(f"{place}/out/batch={k}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{place}/out")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("lapped", "total"), "lapped").alias("r"))
    return last.select("user_id", "r.lapped", (F.round("r.total", 4) + F.lit(0.0)).alias("total"))


@query("""
with e as (select *, epoch_ms(ts) as ms from events where value is not null and ts is not null), g as (select *, lag(value) over w as v, ms - lag(ms) over w as apart from e window w as (partition by user_id order by epoch_ms(ts), event_id))
select user_id, count_if(apart is null or apart >= 14400000)::bigint as primes, count_if(apart < 14400000)::bigint as laps, round(coalesce(sum(value + v) filter (apart < 14400000), 0), 4) as total from g group by user_id""")
def stream_ordered_lap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value added to the one before it in order, state ending after four hours of silence."""
    rows = ordered.run_ordered(spark, events.event_stream(spark, sf_dir), 4 * 3600, _place(spark))
    of = rows.groupBy("user_id").agg(F.count_if(F.col("kind") == "prime").alias("primes"), F.count_if(F.col("kind") == "lap").alias("laps"), F.coalesce(F.sum(F.when(F.col("kind") == "lap", F.col("value"))), F.lit(0.0)).alias("total"))
    return of.select("user_id", "primes", "laps", F.round("total", 4).alias("total"))
