"""The decode side: inverses, prediction and packed floats against plain Python, with nulls and ends."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from lapwing.functions.signal import lit, packed_float
from lapwing.operators import coding, decode, quantise


def test_entries_give_their_vectors_back(spark):
    rows = [(k, [((k // 9**d) % 9) * 0.1 - 0.4 for d in range(3)]) for k in range(729)]
    of = spark.createDataFrame(rows, "k long, x array<double>").withColumn("e", quantise.lattice_entry(F.col("x"), -0.4, 0.1, 9))
    of = of.withColumn("y", decode.lattice_vector(F.col("e"), -0.4, 0.1, 9, 3, F.lit(False))).withColumn("z", decode.lattice_vector(F.col("e"), -0.4, 0.1, 9, 3, F.lit(True)))
    for r in of.collect():
        assert r.e == r.k and np.allclose(r.x, r.y) and np.allclose(np.cumsum(r.x), r.z)
    table = spark.createDataFrame([(0,), (1,), (7,), (None,)], "e int").select(decode.table_vector(F.col("e"), [[1, 2], [3, 4]], 0.5, 2.0, F.lit(True)).alias("v")).collect()
    assert [r.v for r in table] == [[2.5, 7.0], [6.5, 15.0], None, None]


def test_every_post_comes_back_from_its_value(spark):
    size = 40
    rows = spark.createDataFrame(list(itertools.product(range(size), range(size))), "y int, p int")
    for r in rows.withColumn("v", decode.post_value(F.col("y"), F.col("p"), size)).withColumn("h", decode.post_height(F.col("v"), F.col("p"), size)).collect():
        assert r.h == r.y and 0 <= r.v < size


def test_prediction_filter(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(20):
        x = rng.standard_normal(64)
        rows.append((k, [float(x[: 64 - lag] @ x[lag:]) for lag in range(6)]))
    rows += [(100, [0.0] * 6), (101, [1.0] * 6)]
    got = {r.k: r.f for r in spark.createDataFrame(rows, "k long, r array<double>").select("k", decode.prediction_filter(F.col("r"), 5).alias("f")).collect()}
    for k, r in rows[:20]:
        toeplitz = np.array([[r[abs(i - j)] for j in range(5)] for i in range(5)])
        assert np.allclose(got[k].a, np.linalg.solve(toeplitz, -np.array(r[1:]))) and got[k].error > 0
    assert got[100] is None and got[101] is None  # silence, and a process with nothing left to predict


def test_packed_floats_come_back(spark):
    values = [0.0, 1.0, -1.0, 0.5, 3.25, 2097151.0, -2097151.0 * 2**-30, 2097153.0, 0.1, None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(decode.packed_bits(F.col("x")).alias("b")).select(packed_float(F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [*values[:7], None, None, None]


def test_dense_books_hold_every_symbol(spark):
    tallies = spark.createDataFrame([("a", "x", 5), ("a", "y", 1), ("b", "z", 9)], "book string, symbol string, n long")
    got = {(r.book, r.symbol): r.n for r in coding.dense(tallies, tallies.select("symbol").distinct()).collect()}
    assert got == {("a", "x"): 5, ("a", "y"): 1, ("a", "z"): 1, ("b", "x"): 1, ("b", "y"): 1, ("b", "z"): 9}
    assert all(r.complete for r in coding.kraft(coding.code_lengths(coding.dense(tallies, tallies.select("symbol").distinct()))).collect())
    assert coding.dense(tallies.limit(0), tallies.select("symbol")).count() == 0


def test_smallest_choice_and_slots(spark):
    rows = spark.createDataFrame([(1, [[True, False], [False, True]]), (2, [[False, False]]), (3, [])], "k int, f array<array<boolean>>")
    assert {r.k: r.c for r in rows.select("k", decode.smallest_choice(F.col("f"), [3, 2, 0, 6], 1).alias("c")).collect()} == {1: 2, 2: None, 3: 0}
    targets = spark.createDataFrame([(0, 0), (0, 4), (1, 4), (1, 5), (2, None)], "slot int, y int")
    leaves = spark.createDataFrame([(1, 4), (1, 4), (0, 4)], "slot int, y int")
    assert {(r.slot, r.y): r.accepted for r in decode.accepted(targets, leaves, 0).collect()} == {(0, 0): True, (0, 4): False, (1, 4): True, (1, 5): False, (2, None): False}
    assert decode.all_posts([3, 1], 4) == [0, 16, 3, 1]


def test_replay_is_what_the_cascade_saw(spark):
    books = [[[0.0, 0.0], [1.0, 1.0]], [[0.1, 0.0], [0.0, 0.1]]]
    rows = spark.createDataFrame([(k, [0.3 * k, 1 - 0.2 * k]) for k in range(6)], "k int, x array<double>")
    for r in quantise.cascade(rows, books).withColumn("s", decode.replay(F.col("x"), F.col("entries"), books)).collect():
        left = np.array(r.x)
        for s, book in zip(r.s, books):
            assert np.allclose(s.target, left) and s.entry == np.argmin([((left - b) ** 2).sum() for b in np.array(book)])
            left = left - np.array(book[s.entry])
    weights = spark.range(1).select(*[decode.spectral_weight(F.array(*map(lit, (0.4, 0.9, 1.5, 2.1, 2.6)[:n])), n, 8, F.lit(3)).alias(f"w{n}") for n in (4, 5)]).first()
    for n, angles in ((4, (0.4, 0.9, 1.5, 2.1)), (5, (0.4, 0.9, 1.5, 2.1, 2.6))):
        w = np.cos(np.pi * 3 / 8)
        odd, even = np.prod([4 * (np.cos(a) - w) ** 2 for a in angles[1::2]]), np.prod([4 * (np.cos(a) - w) ** 2 for a in angles[::2]])
        both = odd * (1 - w) / 2 + even * (1 + w) / 2 if n == 4 else odd * (1 - w * w) + even * 0.25
        assert abs(weights[f"w{n}"] - both**-0.5) < 1e-9
