"""Closed loops, predicted posts and their books, sliding maxima, comment records: against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lapwing.operators import masking, prediction
from lapwing.sources import records


def line(x0, y0, x1, y1, x):
    offset = abs(y1 - y0) * (x - x0) // (x1 - x0)
    return y0 - offset if y1 < y0 else y0 + offset


def test_closed_loops(spark):
    rng = random.Random(4)
    book = [[round(rng.uniform(0, 0.2) + 0.1 * d, 3) for d in range(3)] for _ in range(9)]
    rows = [(k, [round(v, 4) for v in sorted(rng.uniform(0, 4) for _ in range(rng.randrange(1, 20)))]) for k in range(60)] + [(60, [])]
    table = spark.createDataFrame(rows, "k long, x array<double>")
    closed = open_ = 0.0
    of = table.select("k", "x", prediction.coded_in_loop(F.col("x"), book, 3).alias("c"), prediction.coded_in_loop(F.col("x"), book, 3, closed=False).alias("o"))
    for r in of.select("*", prediction.rebuilt_from(F.transform("c", lambda s: s.entry), book, F.size("x")).alias("b")).collect():
        last, out = 0.0, []
        filled = r.x + r.x[-1:] * (-len(r.x) % 3)
        for v in range(len(filled) // 3):
            target = [a - last for a in filled[3 * v : 3 * v + 3]]
            e = min(range(9), key=lambda e: (round(sum((a - b) ** 2 for a, b in zip(target, book[e])), 9), e))
            out += [last + b for b in book[e]]
            assert r.c[v].entry == e
            last += book[e][2]
        assert [v for s in r.c for v in s.rebuilt] == pytest.approx(out) and r.b == pytest.approx(out[: len(r.x)])
        error = lambda c: sum((a - b) ** 2 for a, b in zip(r.x, [v for s in c for v in s.rebuilt]))  # noqa: E731, B023
        closed, open_ = closed + error(r.c), open_ + error(r.o)
    assert closed < open_


def test_posts_with_any_left_out_come_back(spark):
    rng = random.Random(8)
    rows = []
    for k in range(200):
        xs = [0, 64, *rng.sample(range(1, 64), rng.randrange(0, 12))]
        rows.append((k, xs, [rng.randrange(128) if j < 2 or rng.random() < 0.7 else None for j in range(len(xs))]))
    rows += [(200, [0, 64, 3], [None, 1, 1]), (201, [0, 64, 3], [1, 1, 128]), (202, [0, 64, 3], [1, 1])]
    table = spark.createDataFrame(rows, "k long, xs array<int>, ys array<int>").select("*", prediction.planned_posts(F.col("xs"), F.col("ys"), 128).alias("p"))
    back = prediction.rebuilt_posts(F.col("xs"), F.transform("p", lambda q: q["value"]), 128)
    for r in table.select("*", back.alias("b")).collect():
        if r.k >= 200:
            assert r.p is None and r.b is None
            continue
        done = {}
        for post, again, x, y in zip(r.p, r.b, r.xs, r.ys):
            if len(done) >= 2:
                low, high = max(p for p in done if p < x), min(p for p in done if p > x)
                predicted = line(low, done[low], high, done[high], x)
                assert post.predicted == predicted and 0 <= post.value < 128
                y = predicted if y is None else y
                assert post.coded == (y != predicted) == (post.value != 0)
            done[x] = y
            assert post.y == again.y == y


def test_smallest_choices(spark):
    rng = random.Random(2)
    leaves = [(s, y) for s in range(3) for y in range(12) if rng.random() < 0.6] + [(0, 5), (0, 5)]
    choices = [0, 5, 6, 17, 33, 40, 63, 62]
    targets = [(g, j, rng.randrange(12) if rng.random() < 0.8 else 0) for g in range(300) for j in range(rng.randrange(1, 6))]
    got = prediction.chosen(spark.createDataFrame(targets, "g long, j int, y int").repartition(3), ["g"], spark.createDataFrame(leaves, "slot int, y int"), choices, 2, 3).collect()
    held = set(leaves)
    for r in got:
        mine = [(j, y) for g, j, y in targets if g == r.g]
        fits = [c for c in sorted(choices) if all(y == 0 if c >> 2 * j & 3 == 3 else (c >> 2 * j & 3, y) in held for j, y in mine)]
        assert r.choice == (fits[0] if fits else None)
    assert len(got) == 300 and {r.choice for r in got} - {None}


@pytest.mark.parametrize("radius", [0, 1, 7, 64])
def test_sliding_maxima(spark, radius):
    rng = random.Random(radius)
    streams = {s: [rng.gauss(0, 1) for _ in range(n)] for s, n in ((1, 300), (2, 1), (3, 7), (4, 15), (5, 129), (6, 130))}
    rows = spark.createDataFrame([(s, i, x) for s, v in streams.items() for i, x in enumerate(v)], "s long, i long, x double").repartition(3)
    got = {(r.s, r.i): r.peak for r in masking.peak_envelope(rows, "s", "i", radius, 0.0).collect()}
    assert got == {(s, i): max(abs(x) for x in v[max(0, i - radius) : i + radius + 1]) for s, v in streams.items() for i in range(len(v))}


def test_floors(spark):
    bins = spark.createDataFrame([(f, k, float("inf") if f == 2 and k == 3 else 0.5 * k if f == 1 else 0.0) for f in (0, 1, 2) for k in range(6)], "frame long, k int, x double")
    masked = spark.createDataFrame([(f, k, 0.3) for f in (0, 1, 2) for k in range(5)], "frame long, k int, threshold double")
    got = {(r.frame, r.k): r.envelope for r in masking.floor_envelope(bins, masked, 1).collect()}
    assert got == {(0, k): 0.3 if k < 5 else masking.LADDER_LOW for k in range(6)} | {(1, k): min(1.0, 0.5 * min(k + 1, 5)) for k in range(6)}


def offset(data: bytes) -> int:
    try:
        data.decode()
    except UnicodeDecodeError as e:
        return e.start
    return len(data)


def test_first_bad_offsets(spark):
    text = "aé日本😀\x7fࠀ￿\U0010ffff z\n".encode()
    rng = random.Random(5)
    rows = [text[:k] for k in range(len(text) + 1)] + [text[k:] for k in range(len(text))] + [bytes(rng.choice((0x41, 0x80, 0xBF, 0xC1, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xEF, 0xF0, 0x90, 0xF4, 0x8F, 0xF5, 0xFF)) for _ in range(8)) for _ in range(400)]
    rows += [b"x" * 200_000 + b"\xff", ("日" * 60_000).encode()[:-1]]
    got = spark.createDataFrame([(bytearray(r),) for r in rows], "d binary").select("d", records.valid_up_to(F.col("d")).alias("n"), records.decoded(F.col("d")).alias("t")).collect()
    for r in got:
        assert r.n == offset(bytes(r.d))
        assert r.t == (bytes(r.d).decode() if r.n == len(r.d) else None)


def packed(vendor: str, comments: list[str], last: int = 1) -> bytes:
    field = lambda b: len(b).to_bytes(4, "little") + b
    return b"\x03" + records.MAGIC.encode() + field(vendor.encode()) + len(comments).to_bytes(4, "little") + b"".join(field(c.encode()) for c in comments) + bytes([last])


def test_comment_records(spark):
    cases = [("", []), ("v", ["a=b"]), ("Ünï", ["日=本", "", "no sign", "x" * 300]), ("v", ["y"] * 90)]
    table = spark.createDataFrame([(k, v, c) for k, (v, c) in enumerate(cases)], "k int, v string, c array<string>")
    for r in table.select("*", records.comment_record(F.col("v"), F.col("c")).alias("d")).select("*", records.parsed_comments(F.col("d")).alias("r")).collect():
        assert bytes(r.d) == packed(r.v, r.c) and (r.r.vendor, r.r.comments) == (r.v, r.c)
    whole = packed("Ünï", ["日=本", "", "zz"])
    bad = [whole[:k] for k in range(len(whole))]
    bad += [packed("v", ["a"], 0), b"\x01" + whole[1:], b"\x03" + b"other!" + whole[7:], whole[:7] + b"\xff\xff\xff\xff" + whole[11:], packed("v", [])[:12] + b"\xff\xff\xff\xff\x01", packed("v", ["a"]).replace(b"a", b"\xff")]
    got = spark.createDataFrame([(bytearray(b),) for b in bad] + [(None,)], "d binary").select(records.parsed_comments(F.col("d")).alias("r")).collect()
    assert all(r.r is None for r in got)
    extra = spark.createDataFrame([(bytearray(whole + b"more"),)], "d binary").select(records.parsed_comments(F.col("d")).alias("r")).first().r
    assert extra.comments == ["日=本", "", "zz"]
