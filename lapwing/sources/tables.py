"""Tables as signals: event values as streams of samples, embeddings as frames of 64."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators import scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(events: DataFrame) -> DataFrame:
    """(stream, i, x): each user's values in order of time, ties by event_id; i counts from 0. Events without a value are left out.

    Places are counted in two levels, over ranges of time and inside them, so a user of very many events is spread over tasks.
    """
    rows = events.where("value is not null").select(F.col("user_id").alias("stream"), "ts", "event_id", F.col("value").alias("x"))
    return scan.numbered(rows, "stream", "ts", "event_id").select("stream", "i", "x")


def frames(embeddings: DataFrame) -> DataFrame:
    """(frame, label, x): one frame of doubles for each vector."""
    return embeddings.select(F.col("vec_id").alias("frame"), "label", F.col("embedding").cast("array<double>").alias("x"))


def bins(framed: DataFrame) -> DataFrame:
    """(frame, label, k, x): frames in long form."""
    return framed.select("frame", "label", F.posexplode("x").alias("k", "x"))
