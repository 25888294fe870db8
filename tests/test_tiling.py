"""Tilings against a search over all lists of classes, and headers against a plain walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lapwing.operators import tiling


def fewest(posts: int, sizes: list[int]) -> list[int] | None:
    """Breadth first: the least count for each place, each by the first class that gives it."""
    if posts < 1 or not 1 <= len(sizes) <= 16 or any(not 1 <= d <= 8 for d in sizes):
        return None
    level, counts, depth = {0}, {0: 0}, 0
    while level and posts not in counts:
        depth += 1
        level = {p + d for p in level for d in sizes if p + d <= posts and p + d not in counts}
        counts |= dict.fromkeys(level, depth)
    if counts.get(posts, 99) > 31:
        return None
    classes, left = [], posts
    while left:
        classes.insert(0, next(c for c, d in enumerate(sizes) if d <= left and counts.get(left - d) == counts[left] - 1))
        left -= sizes[classes[0]]
    return classes


def test_all_tilings(spark):
    rng = random.Random(6)
    catalogues = [[1], [8], [3, 2], [2, 3], [5, 7], [4, 6], [9, 1], [0, 1], [], [1] * 17, [8, 8, 1]] + [[rng.randrange(1, 9) for _ in range(rng.randrange(1, 6))] for _ in range(12)]
    rows = [(p, k) for p in range(66) for k in range(len(catalogues))]
    table = spark.createDataFrame([(k, c) for k, c in enumerate(catalogues)], "k int, sizes array<int>")
    asked = spark.createDataFrame(rows, "posts int, k int").join(F.broadcast(table), "k")
    for r in asked.select("posts", "sizes", tiling.tiling(F.col("posts"), F.col("sizes")).alias("c")).collect():
        assert r.c == fewest(r.posts, r.sizes), (r.posts, r.sizes)
        if r.c:
            assert sum(r.sizes[c] for c in r.c) == r.posts


@pytest.mark.parametrize("sizes", [[3, 2], [1, 4], [8]])
def test_headers_own_all_posts(spark, sizes):
    rng = random.Random(2)
    frames = [(k, [abs(rng.gauss(0, 1)) * rng.choice((1e-6, 0.01, 1)) for _ in range(32)]) for k in range(25)] + [(25, [0.5] * 32)]
    of = spark.createDataFrame(frames, "frame long, x array<double>")
    for r in of.select("frame", tiling.envelope_header(F.col("x"), 32, 6, 1.0, F.array(*map(F.lit, sizes))).alias("h"), tiling.plan_posts(F.col("x"), 32, 6, 1.0).alias("posts")).collect():
        if r.posts and fewest(len(r.posts), sizes) is None:
            assert r.h is None
            continue
        assert r.h.range_bits == 5 and r.h.posts == r.posts and r.h.classes == (fewest(len(r.posts), sizes) if r.posts else [])
        assert [x for part in r.h.parts for x in part] == r.posts and [len(p) for p in r.h.parts] == [sizes[c] for c in r.h.classes]
    assert r.frame == 25 and r.h.posts == [] and r.h.parts == []


def test_range_bits(spark):
    got = spark.range(1, 300).select(tiling.range_bits(F.col("id")).alias("b")).collect()
    assert [r.b for r in got] == [(n - 1).bit_length() for n in range(1, 300)]
