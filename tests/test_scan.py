"""Two-level scans against plain walks, with one stream of a third of all rows and stretches far shorter than it."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lapwing.operators import layout, masking, scan, transform
from lapwing.sources.tables import samples


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(12)
    found = {}
    for s, n in ((1, 2600), (2, 1), (3, 700), (4, 130), (5, 64), (6, 2000), (7, 2500)):
        level, x = 1.0, []
        for _ in range(n):
            if rng.random() < 0.01:
                level = rng.choice((0.01, 0.3, 1, 20, 0))
            x.append(abs(rng.gauss(0, 1)) * level + (1e-3 if level else 0))
        found[s] = x
    return found


@pytest.fixture(scope="module")
def rows(spark, streams):
    table = spark.createDataFrame([(s, i, v) for s, x in streams.items() for i, v in enumerate(x)], "stream long, i long, x double")
    return table.repartition(5).persist()


def schedule(x: list[float], short=64, long=128, subframes=16, peak=3.0, rise=4.0):
    def ahead(g):
        part = x[g : g + long]
        count = min(subframes, len(part))
        width = len(part) // count
        e = [sum(v * v for v in part[k * width : (k + 1) * width if k < count - 1 else None]) for k in range(count)]
        return max(e), sum(e) / count

    def decide(here, before):
        return not ((here[1] > 0 and here[0] / here[1] > peak) or (before is not None and here[0] > rise * max(before, 2.2250738585072014e-308)))

    g, flag, before = 0, decide(ahead(0), None), ahead(0)[1]
    out = [(0, flag, 0)]
    while g < len(x):
        here = ahead(g)
        now = decide(here, before)
        g += ((long if flag else short) + (long if now else short)) // 4
        flag, before = now, here[1]
        out.append((len(out), flag, g))
    return out


@pytest.mark.parametrize("short,long,stretch,fan", [(64, 128, 512, 512), (64, 128, 4, 3), (64, 128, 7, 2), (16, 64, 16, 5), (32, 32, 5, 4)])
def test_block_schedule(rows, streams, monkeypatch, short, long, stretch, fan):
    entered = scan.entered
    monkeypatch.setattr(scan, "entered", lambda maps, key, states, first: entered(maps, key, states, first, fan))
    got = defaultdict(list)
    for r in transform.block_schedule(rows, short, long, stretch=stretch).collect():
        got[r.stream].append((r.b, r.long, r.granule))
    for s, x in streams.items():
        assert sorted(got[s]) == schedule(x, short, long)


@pytest.mark.parametrize("chunk", [4096, 64, 1])
def test_temporal_masking_and_granules(rows, streams, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    masked = masking.temporal_masking(rows.where("x > 0").select("stream", "i", F.col("x").alias("t")), "stream", "i", 0.8, 0.25)
    whole = {s for s, x in streams.items() if min(x) > 0}
    got = {(r.stream, r.i): r.effective for r in masked.collect()}
    for s in whole:
        lasting = 0.0
        for i, v in enumerate(streams[s]):
            ahead = streams[s][i + 1] * 0.25 if i + 1 < len(streams[s]) else v
            lasting = max(max(v, ahead), lasting * 0.8)
            assert math.isclose(got[s, i], lasting, rel_tol=1e-9)
    walk = transform.lap_granules(rows.select("stream", F.col("i").alias("b"), F.when(F.col("x") > 1, 256).otherwise(64).alias("n")))
    got = {(r.stream, r.b): r.granule for r in walk.collect()}
    for s, x in streams.items():
        sizes, at = [256 if v > 1 else 64 for v in x], 0
        for b, n in enumerate(sizes):
            at += (sizes[b - 1] + n) // 4 if b else 0
            assert got[s, b] == at


@pytest.mark.parametrize("chunk", [4096, 32, 1])
def test_fills_and_totals(rows, streams, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    sparse = rows.withColumn("v", F.when((F.col("x") * 1000).cast("long") % 7 == 3, F.col("x")))
    of = scan.running_total(scan.last_known(sparse, "stream", "i", "v", "filled"), "stream", "i", F.col("v").isNotNull(), "seen")
    got = {(r.stream, r.i): (r.v, r.filled, r.seen) for r in of.collect()}
    for s, x in streams.items():
        known = [got[s, i][0] for i in range(len(x))]
        last, seen = next((v for v in known if v is not None), None), 0
        for i, v in enumerate(known):
            last = v if v is not None else last
            assert got[s, i][1:] == (last, seen)
            seen += v is not None


def test_packets_and_overlaps(spark):
    rng = random.Random(9)
    events = [(k, rng.choice((1, 1, 2)), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(50)), rng.random() < 0.1) for k in range(800)]
    got = {r.id: r.packet for r in layout.assembled(spark.createDataFrame(events, "id long, user long, ts timestamp, e boolean").repartition(6), "user", F.col("e"), "ts", "id").collect()}
    for user in (1, 2):
        n = 0
        for k, _, _, ends in sorted((e for e in events if e[1] == user), key=lambda e: (e[2], e[0])):
            assert got[k] == n
            n += ends
    framed = [(s, f, [float(rng.randrange(9)) for _ in range(8)]) for s, n in ((1, 50), (2, 1), (3, 2)) for f in range(n)]
    x = {(s, f): v for s, f, v in framed}
    lapped = {(r.stream, r.i): r.x for r in transform.overlap_add(spark.createDataFrame(framed, "stream long, f long, x array<double>").repartition(4), 8).collect()}
    assert lapped == {(s, (f - 1) * 4 + k): x[s, f][k] + x[s, f - 1][k + 4] for s, f in x if f for k in range(4)}


def test_numbers_of_a_skewed_user_with_equal_times(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    events = [(k, rng.choice((1, 1, 1, 2, 3)), start + timedelta(seconds=rng.choice((5, rng.randrange(4000)))), None if k % 50 == 0 else float(k)) for k in range(3000)]
    table = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, value double").repartition(7)
    expected = {}
    for user in (1, 2, 3):
        mine = sorted((t, k, v) for k, u, t, v in events if u == user and v is not None)
        expected |= {(user, i): v for i, (_, _, v) in enumerate(mine)}
    assert {(r.stream, r.i): r.x for r in samples(table).collect()} == expected
    assert samples(table.limit(0)).count() == 0


def test_null_keys_are_a_stream(spark):
    rows = spark.createDataFrame([(None if i % 2 else 1, i // 2, float(i)) for i in range(20)], "s long, i long, x double")
    null = lambda frame, c: [r[c] for r in frame.where("s is null").orderBy("i").collect()]
    assert null(scan.sliding_maximum(rows, "s", "i", F.col("x"), 1, "m"), "m") == [3.0, 5, 7, 9, 11, 13, 15, 17, 19, 19]
    assert null(scan.running_total(rows, "s", "i", F.col("x"), "t"), "t") == [0, 1, 4, 9, 16, 25, 36, 49, 64, 81]
    assert null(scan.last_known(rows, "s", "i", "x", "v"), "v") == [float(v) for v in range(1, 20, 2)]
    assert null(scan.running_steps(rows, "s", "i", "x", lambda a, b: b - a, "d"), "d") == list(range(0, 20, 2))
    assert null(scan.decaying_maximum(rows, "s", "i", "x", 0.5, 0.0, "e"), "e")[-1] == pytest.approx(19.0)
    events = spark.createDataFrame([(k, None, datetime(2024, 1, 1) + timedelta(seconds=k), float(k)) for k in range(5)], "event_id long, user_id long, ts timestamp, value double")
    assert [(r.stream, r.i) for r in samples(events).orderBy("i").collect()] == [(None, k) for k in range(5)]


def test_no_window_holds_a_stream(rows, spark, sf_dir):
    """Windows by stream alone stand above an aggregation by stretch, so their rows are stretches."""
    of = masking.temporal_masking(rows.select("stream", "i", F.col("x").alias("t")), "stream", "i", 0.8, 0.25)
    plan = of._jdf.queryExecution().optimizedPlan().toString().split("\n")
    for k, line in enumerate(plan):
        if "Window [" in line and "_chunk" not in line.split("], [")[1]:
            deeper = "\n".join(plan[k : k + 6])
            assert "Aggregate [stream" in deeper
