"""A session with the settings the engine expects: UTC, adaptive plans, Arrow, state on RocksDB."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one. Dots in setting names are written as double underscores."""
    builder = SparkSession.builder.appName("lapwing").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return (builder.master(master) if master else builder).getOrCreate()
