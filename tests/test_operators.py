"""Properties that SQL doesn't state: round trips, optimal codes, monotone training, column functions on edge values."""

from __future__ import annotations

import heapq
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapwing.functions import signal
from lapwing.operators import coding, quantise, relational, transform
from lapwing.operators.coding import _lengths
from lapwing.plans.catalogue import QUERIES
from lapwing.sources.packets import identification, packet_kind


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    return cost


@given(st.lists(st.integers(1, 10_000), min_size=2, max_size=60))
@settings(max_examples=60, deadline=None)
def test_package_merge_is_optimal(counts):
    lengths = _lengths(counts, 32)
    assert sum(c * n for c, n in zip(counts, lengths)) == huffman_cost(counts)
    assert sum(2.0**-n for n in lengths) == 1


@given(st.lists(st.integers(1, 10_000), min_size=2, max_size=16))
@settings(max_examples=60, deadline=None)
def test_package_merge_keeps_its_limit(counts):
    lengths = _lengths(counts, 4)
    assert max(lengths) <= 4 and sum(2.0**-n for n in lengths) == 1


def test_one_symbol_takes_one_bit():
    assert _lengths([7], 8) == [1]


def test_codewords_are_prefix_free_and_in_order(spark):
    lengths = spark.createDataFrame([("b", s, n) for s, n in zip("abcde", (2, 4, 4, 4, 1))] + [("b", "f", 4)], "book string, symbol string, length int")
    codes = {r.symbol: r.code for r in coding.codewords(lengths).collect()}
    assert codes == {"a": "00", "b": "0100", "c": "0101", "d": "0110", "e": "1", "f": "0111"}


def test_too_many_codewords_fail(spark):
    lengths = spark.createDataFrame([("b", s, 1) for s in "abc"], "book string, symbol string, length int")
    with pytest.raises(Exception, match="more codewords"):
        coding.codewords(lengths).collect()


def test_coupling_round_trip(spark):
    values = [-2.0, -1.0, -0.0, 0.0, 0.5, 1.0, 3.0]
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "l double, r double")
    back = rows.select("l", "r", signal.couple(F.col("l"), F.col("r")).alias("c")).select("l", "r", signal.uncouple(F.col("c.magnitude"), F.col("c.angle")).alias("u"))
    assert all(r.u.left == r.l and r.u.right == r.r for r in back.collect())


def test_window_is_power_complementary(spark):
    rows = spark.range(64).select(F.col("id").cast("int").alias("i"))
    full = signal.hybrid_window(F.col("i"), 64, 64, F.lit(False), F.lit(True), F.lit(True))
    w = [r.w for r in rows.orderBy("i").select(full.alias("w")).collect()]
    assert all(abs(w[i] ** 2 + w[i + 32] ** 2 - 1) < 1e-12 for i in range(32))


def test_ladder_place_inverts_level(spark):
    rows = spark.range(256).select(F.col("id").alias("k"), signal.ladder_place(signal.ladder_level(F.col("id"))).alias("p"))
    assert all(r.k == r.p for r in rows.collect())
    ends = spark.createDataFrame([(0.0,), (-1.0,), (2.0,)], "x double").select(signal.ladder_place(F.col("x")).alias("p"))
    assert [r.p for r in ends.collect()] == [0, 0, 255]


def test_product_levels():
    assert [signal.product_levels(n, d) for n, d in ((6561, 4), (6560, 4), (1, 3), (0, 2), (1 << 24, 8))] == [9, 8, 1, 0, 8]


def test_schedule_of_a_silent_stream_is_long(spark):
    quiet = spark.range(600).select(F.lit(1).alias("stream"), F.col("id").alias("i"), F.lit(0.0).alias("x"))
    of = transform.block_schedule(quiet).orderBy("b").collect()
    assert all(r.long for r in of) and [r.granule for r in of[:4]] == [0, 64, 128, 192]


def test_attack_makes_a_short_block(spark):
    rows = spark.range(600).select(F.lit(1).alias("stream"), F.col("id").alias("i"), F.when(F.col("id") == 300, 100.0).otherwise(0.01).alias("x"))
    of = transform.block_schedule(rows).orderBy("b").collect()
    assert any(not r.long for r in of if 150 <= r.granule <= 300)


def test_empty_inputs_give_no_rows(spark):
    none = spark.createDataFrame([], "stream long, i long, x double")
    assert transform.transients(none).count() == 0
    assert transform.hop_frames(none, 32).count() == 0
    assert transform.block_schedule(none).count() == 0
    assert relational.stride_sample(none, "i", 5).count() == 0
    assert quantise.lloyd_levels(none, "x", 4) == ([], [])


def test_lloyd_error_never_rises(spark):
    rows = spark.range(500).select(((F.col("id") * 37) % 101).cast("double").alias("v"))
    _, errors = quantise.lloyd_levels(rows, "v", 6)
    assert errors and all(a >= b - 1e-9 for a, b in zip(errors, errors[1:]))


def test_rate_bisection_meets_the_budget(spark, sf_dir):
    steps = QUERIES["rate_bisection"](spark, sf_dir).collect()
    assert steps and any(r.bits <= r.budget for r in steps)


def test_malformed_packets(spark):
    rows = spark.createDataFrame([(None,), (bytearray(),), (bytearray(b"\x01vorbi"),), (bytearray(b"\x01vorbis"),), (bytearray(b"\x05vorbis\x00"),), (bytearray(b"\x00"),)], "data binary")
    of = rows.select(packet_kind(F.col("data")).alias("k"), identification(F.col("data")).alias("r")).collect()
    assert [r.k for r in of] == [None, None, None, "identification", "setup", "audio"]
    assert all(r.r is None for r in of)


def test_packed_float(spark):
    rows = spark.createDataFrame([(788 << 21 | 1,), (1 << 31 | 789 << 21 | 3,), (0,)], "b long").select(signal.packed_float(F.col("b")).alias("v"))
    assert [r.v for r in rows.collect()] == [1.0, -6.0, 0.0]


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["stream", "block", "n", "peak_energy", "mean_energy", "peak_to_mean", "short"] and found.count() > 0
    assert math.isfinite(found.first().peak_energy)


def test_stride_sample_takes_every_nth_row_in_order(spark):
    keys = [-5, 0, 3, 3, 900, 10**6] + list(range(10, 400, 7))
    rows = spark.createDataFrame([(None,)] + [(k,) for k in reversed(keys)], "k long").repartition(5)
    ordered = [None, *sorted(keys)]
    for most in (1, 4, 10, 1000):
        stride = max(1, -(-len(ordered) // most))
        taken = [r.k for r in relational.stride_sample(rows, "k", most).orderBy("k").collect()]
        assert taken == ordered[::stride]
    assert relational.stride_sample(rows.limit(0), "k", 4).count() == 0
