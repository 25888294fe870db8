"""Queries against their SQL on small tables with odd rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb

from lapwing.plans.catalogue import ORACLE, QUERIES


def held_against_sql(spark, folder, name: str, of: str, rows: list[tuple], schema: str) -> list[tuple]:
    """The query's rows over one table of these rows, after comparing them with its SQL's."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{of}.parquet")
    db = duckdb.connect()
    db.sql(f"create view {of} as select * from '{folder}/{of}.parquet/*.parquet'")
    mine, theirs = QUERIES[name](spark, str(folder)).toPandas(), db.sql(ORACLE[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    plain = lambda frame: sorted(tuple(map(str, r)) for r in frame[columns].itertuples(index=False))
    assert plain(mine) == plain(theirs)
    return plain(mine)


def events(streams: dict[int, list[float]]) -> list[tuple]:
    start = datetime(2024, 1, 1)
    return [(user * 10_000 + k, start + timedelta(seconds=k), user, x) for user, values in streams.items() for k, x in enumerate(values)]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, value double"


def test_frames_hold_samples_of_zero_and_below(spark, tmp_path):
    streams = {1: [0.0] * 20, 2: [float(k % 3) for k in range(50)], 3: [-1.5 - k for k in range(21)]}
    assert held_against_sql(spark, tmp_path, "hop_frames", "events", events(streams), EVENTS)


DOCUMENTS = "doc_id long, text string, lang string"


def steep_texts() -> list[str]:
    """Texts of 31 symbols with Fibonacci counts: an optimal code has words of 30 bits."""
    counts = [1, 1]
    while len(counts) < 31:
        counts.append(counts[-1] + counts[-2])
    return [chr(0x100 + k) * n for k, n in enumerate(counts)]


def test_codes_of_steep_counts_take_the_least_bits(spark, tmp_path):
    rows = [(k, t, "a") for k, t in enumerate(steep_texts())] + [(90, "xyzzy \U0001f469́", "b"), (91, None, "b"), (92, "", "c")]
    assert len(held_against_sql(spark, tmp_path, "kraft_check", "documents", rows, DOCUMENTS)) == 2


def test_a_lone_symbol_and_a_null_book(spark, tmp_path):
    rows = [(1, "aaaa", "a"), (2, "abc", None), (3, "abcc", "b")]
    held_against_sql(spark, tmp_path, "kraft_check", "documents", rows, DOCUMENTS)


def test_dense_codes_of_steep_counts_and_of_a_null_book(spark, tmp_path):
    rows = [(k, t, "a") for k, t in enumerate(steep_texts())] + [(90, "xyzzy", "b"), (91, "\U0001f469", None)]
    assert len(held_against_sql(spark, tmp_path, "dense_redesign", "documents", rows, DOCUMENTS)) == 2


def test_a_dense_book_of_one_symbol(spark, tmp_path):
    held_against_sql(spark, tmp_path, "dense_redesign", "documents", [(1, "aa", "a"), (2, "a", "b")], DOCUMENTS)


def test_schedule_of_silence(spark, tmp_path):
    loud = [float(1 + k * 37 % 11) for k in range(300)]
    streams = {1: [0.0], 2: loud[:64] + [0.0], 3: loud[:200] + [0.0] * 300 + loud, 4: [0.0] * 200 + loud, 5: loud[:256] + [0.0] * 9, 6: [0.0] * 129}
    held_against_sql(spark, tmp_path, "block_schedule", "events", events(streams), EVENTS)
