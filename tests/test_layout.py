"""Layouts that SQL doesn't state, walked in plain Python."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lapwing.functions.signal import LADDER_LOW, LADDER_SIZE
from lapwing.operators import layout, quantise
from lapwing.plans.catalogue import QUERIES
from lapwing.plans.layout_queries import STEPS


def place(x: float) -> int:
    level = lambda k: math.exp((1 - k / (LADDER_SIZE - 1)) * math.log(LADDER_LOW))
    return min(range(LADDER_SIZE), key=lambda k: (abs(level(k) - x), k))


def walked_posts(y: list[float], most: int) -> list[int]:
    n, posts = len(y), [(0, y[0]), (len(y), y[-1])]
    for _ in range(most):
        worst, at = 0.0, None
        for (x0, y0), (x1, y1) in zip(posts, posts[1:]):
            for x in range(x0 + 1, min(x1, n)):
                e = abs(y[x] - (y0 + (y1 - y0) * (x - x0) / (x1 - x0)))
                if e > worst:
                    worst, at = e, x
        if at is None:
            break
        posts = sorted([*posts, (at, y[at])])
    return [x for x, _ in posts if 0 < x < n]


def test_posts(spark, sf_dir):
    frames = {r.frame: [abs(v) for v in r.x] for r in layout_frames(spark, sf_dir)}
    found: dict = {}
    for r in QUERIES["post_plan"](spark, sf_dir).where("frame < 40").orderBy("frame", "k").collect():
        found.setdefault(r.frame, []).append(r.x)
    assert found and all(found[f] == walked_posts([float(place(v)) for v in frames[f]], 5) for f in found)


def layout_frames(spark, sf_dir):
    from lapwing.sources.tables import frames, table

    return frames(table(spark, sf_dir, "embeddings")).where("frame < 40").collect()


def test_pruned_steps(spark, sf_dir):
    def walk(x):
        work, kept = [x[c * 16 : c * 16 + 16] for c in range(4)], []
        for k, (a, b) in enumerate(STEPS):
            pairs = []
            for left, right in zip(work[a], work[b]):
                m = left if (left > 0) == (left > right) else right
                pairs.append((m, left - right if left > 0 else right - left))
            m, n = sum(p * p for p, _ in pairs), sum(q * q for _, q in pairs)
            if (n / m <= 1.2) if m > 0 else n == 0:
                kept.append(k)
                work[a], work[b] = [p for p, _ in pairs], [q for _, q in pairs]
        return kept

    expected = {r.frame: walk(r.x) for r in layout_frames(spark, sf_dir)}
    assert {r.frame: list(r.kept) for r in QUERIES["coupling_prune"](spark, sf_dir).where("frame < 40").collect()} == expected


def test_zero_floor_under_something_fails(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "x array<double>, f array<double>")
    with pytest.raises(Exception, match="over a floor of 0"):
        rows.select(layout.factored(F.col("x"), F.col("f"))).collect()


def test_codebook_training_lowers_the_error(spark):
    rows = spark.range(200).select(F.array(*[((F.col("id") * k) % 17).cast("double") for k in (3, 5)]).alias("x"))
    book, errors = quantise.design_codebook(rows, 4, 2)
    assert len(book) == 4 and errors[-1] < errors[0]
    assert quantise.design_codebook(rows.where("false"), 4, 2) == ([], [])
