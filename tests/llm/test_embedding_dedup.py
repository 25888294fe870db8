"""Near-duplicate embeddings against all pairs in double precision."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from lapwing.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, node int, n int, unit int, home int"


def brute(rows, cosine=0.93):
    usable = {}
    for k, (_, x, label, *_) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x) or not any(x):
            continue
        y = np.array(x) / np.abs(x).max()
        usable[k] = y / np.linalg.norm(y)
    near = {k: [j for j in usable if j != k and rows[j][2] == rows[k][2] and len(usable[j]) == len(usable[k]) and usable[j] @ usable[k] >= cosine] for k in usable}
    out, of = [], {}
    for k in range(len(rows)):
        if k in of:
            continue
        todo, group = [k], {k}
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in group:
                    group.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        of |= dict.fromkeys(group, least)
    for k, r in enumerate(rows):
        out.append((r[0], len(near.get(k, [])), of[k], r[0] == of[k]))
    return Counter(out)


def vectors(seed: int, dims: int = 12, n: int = 300):
    """Tight groups, wide groups whose members link in part only, single vectors, copies, multiples, and rows that link with nothing."""
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for spread, size in ((0.01, 40), (0.06, 60), (0.1, 60), (0.13, 50), (0.2, 30)):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((k, (centre + rng.normal(size=dims) * spread).tolist(), int(rng.integers(0, 2))))
            k += 1
    for _ in range(n):
        rows.append((k, rng.normal(size=dims).tolist(), int(rng.integers(0, 3))))
        k += 1
    rows += [(900 + j, rows[5][1], 1) for j in range(6)] + [(910, [3 * v for v in rows[5][1]], 1), (911, [-v for v in rows[5][1]], 1)]
    rows += [(920, None, 1), (921, [], 1), (922, [0.0] * dims, 1), (923, [math.nan] + [1.0] * (dims - 1), 1), (924, [math.inf] * dims, 1), (925, [None] + [1.0] * (dims - 1), 1)]
    rows += [(926, rows[5][1], None), (None, rows[7][1], rows[7][2]), (None, [1.0] + [0.0] * (dims - 1), 77), rows[3], rows[3], (927, [1e200] * dims, 5), (928, [1e-200] * dims, 5), (929, [1.0, 2.0], 1), (930, [1.0, 2.1], 1)]
    order = rng.permutation(len(rows))
    return [(*rows[j], 1, 2, 3, 4) for j in order]


@pytest.mark.parametrize("seed,block,sample", [(1, 8192, 4096), (2, 37, 4096), (3, 64, 40)])
def test_all_pairs(spark, monkeypatch, seed, block, sample):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", sample)
    rows = vectors(seed)
    got = Counter(map(tuple, embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()))
    assert got == brute(rows)


def test_empty_and_unlinked(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(3, None, 1, 1, 1, 1, 1), (None, [0.0, 0.0], 1, 1, 1, 1, 1), (3, None, 1, 1, 1, 1, 1)]
    assert Counter(map(tuple, embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter({(3, 0, 3, True): 2, (None, 0, None, True): 1})


def test_no_link_escapes_homes_and_guests():
    rng = np.random.default_rng(8)
    r = math.sqrt(2 - 2 * 0.93)
    for dims in (3, 8, 32):
        x = rng.normal(size=(600, dims))
        x[300:] = x[rng.integers(0, 30, 300)] + rng.normal(size=(300, dims)) * rng.choice([0.02, 0.1, 0.3], (300, 1)) * np.sqrt(3 / dims)
        x /= np.linalg.norm(x, axis=1)[:, None]
        balls, cells = embedding_dedup.pivots(x[::3], 9, r)
        assert len(balls) and len(cells) > 1
        home, at, row, place, _ = embedding_dedup.homes_and_guests(x, balls, cells, r)
        visits = set(zip(row.tolist(), place.tolist()))
        near = x @ x.T >= 0.93
        for a, b in zip(*np.nonzero(near)):
            if home[a] < home[b]:
                assert (b, home[a]) in visits
        for k in range(len(balls)):
            assert near[np.ix_(home == k, home == k)].all()


def test_merged_sets():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    root = embedding_dedup._merged(np.arange(200), a, b)
    least = list(range(200))
    for _ in range(200):
        for x, y in zip(a, b):
            least[x] = least[y] = min(least[x], least[y])
    assert root.tolist() == least
