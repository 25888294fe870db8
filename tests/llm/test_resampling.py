"""Importance resampling against plain Python: features, gains, scores, the cutoff among ties, ranks."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapwing.llm import resampling
from lapwing.llm.common import ranked

SCHEMA = "doc_id long, text string, rank int, score int, place int, weight int, n_words int"
LOWER = {k: k + 32 for k in range(65, 91)}


def features(text, runs):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[k : k + n]) for n in range(runs[0], runs[1] + 1) for k in range(len(words) - n + 1)]


def brute(rows, items, runs=(1, 1), buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, features(r[1], runs)[1]))
    for text in items:
        t.update(map(bucket, features(text, runs)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for r in rows:
        n, found = features(r[1], runs)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((n, r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[2], x[3]))
    drawn = able[: len(able) * percent // 100]
    result = [(*x[1:], k) for k, x in enumerate(drawn, 1)]
    left = Counter(x[1:] for x in out) - Counter(x[1:] for x in drawn)
    return Counter(result + [(*x, None) for x in left.elements()])


def awkward():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "don't", "x,y", "THE", "日本", "z" * 70, "q" * 200, "\x7f", "9"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(10, 60)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \n.,"), (203, "one"), (204, "long word " * 4000), (205, "z" * 90_000), (None, "w1 " * 25), (None, rows[3][1]), rows[5], rows[5], (6, rows[7][1])]
    return [(*r, 1, 2, 3, 4, 5) for r in rows]


ITEMS = ["w1 w2 w3 the don't", "w4 ünï 日本", None, ""]


@pytest.mark.parametrize("runs,percent", [((1, 1), 10), ((1, 2), 50), ((2, 3), 100)])
def test_against_plain_python(spark, runs, percent):
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    items = spark.createDataFrame([(t,) for t in ITEMS], "text string")
    got = Counter(map(tuple, resampling.resample(docs, items, runs=runs, percent=percent).collect()))
    assert got == brute(awkward(), [t or "" for t in ITEMS], runs, percent=percent)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(awkward(), SCHEMA)
    items = spark.createDataFrame([(t,) for t in ITEMS], "text string")
    assert resampling.resample(none, items).count() == 0
    assert Counter(map(tuple, resampling.resample(some, items.limit(0)).collect())) == brute(awkward(), [])
    assert resampling.resample(some.where("doc_id > 199"), items).where("rank is not null").count() == 0


@pytest.mark.parametrize("bracket", [1e-9, 0.002, 0.3])
def test_cutoff_among_ties_and_wrong_brackets(spark, bracket):
    rows = [(k % 7, 25, 25, (k * k) % 11, 5 if k % 3 else (k * 37) % 1000, k) for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long, place long").repartition(5)
    order = sorted(rows, key=lambda r: (-r[4], r[0], r[2], r[3], r[5]))
    for k in (1, 2, 150, 333, 600):
        row = resampling.cutoff_row(table, k, bracket)
        assert (row.score, row.doc_id, row.place) == (order[k - 1][4], order[k - 1][0], order[k - 1][5])
        assert table.where(resampling._not_behind(row)).count() == k


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("v")).repartition(9)
    got = [r.id for r in ranked(rows, F.col("v").desc(), F.col("id")).orderBy("rank").collect()]
    assert got == sorted(range(5000), key=lambda k: (-(k * 7919 % 13), k))
    assert ranked(rows.limit(0), F.col("id")).count() == 0


def test_crc_of_spans():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    starts, sizes = rng.integers(0, 4000, 300), rng.integers(0, 900, 300)
    assert resampling.crc32_spans(data, starts, sizes).tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(starts, sizes)]
    bucket, owner, n = resampling.run_buckets(pa.array(["a b c", "", "d"]), (2, 3), 1000)
    assert bucket.tolist() == [zlib.crc32(x) % 1000 for x in (b"a b", b"b c", b"a b c")] and owner.tolist() == [0, 0, 0] and n.tolist() == [3, 0, 1]
