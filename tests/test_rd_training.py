"""Rate-distortion planning and training against a replay in plain Python."""

from __future__ import annotations

import random

import pytest

from lapwing.operators import coding, rd_training
from lapwing.operators.rd_training import Book, Books


def plan(x, books: Books, price, weight=1.0, bias=None):
    ways = []
    for c, names in enumerate(books.classes):
        if any(all(b is None for b in books.of[n].bits) for n in names):
            continue
        left, bits, stages = list(x), 0, []
        for n in names:
            book = books.of[n]
            d2 = lambda e: round(sum((a - v) ** 2 for a, v in zip(left, book.values[e])), 9)  # noqa: E731, B023
            e = min((e for e in range(len(book.bits)) if book.bits[e] is not None), key=lambda e: (d2(e), e))
            stages.append((n, e, tuple(left)))
            left, bits = [a - v for a, v in zip(left, book.values[e])], bits + book.bits[e]
        error = weight * sum(v * v for v in left)
        ways.append((round(error + price * bits + (bias[c] if bias else 0), 9), len(names), c, stages, bits))
    return min(ways, key=lambda w: w[:3])


def look(rows, books, price):
    plans = [plan(x, books, price) for x in rows]
    counts = {n: {} for n in books.of}
    for p in plans:
        for n, e, target in p[3]:
            counts[n].setdefault(e, []).append(target)
    return plans, round(sum(p[0] for p in plans), 6), counts


def replay(rows, books: Books, price, rounds):
    costs, before = [], None
    plans, cost, counts = look(rows, books, price)
    for _ in range(rounds):
        costs.append(cost)
        if plans == before:
            break
        before = plans
        of = {}
        for n, book in books.of.items():
            seen = sorted(counts[n])
            bits = dict(zip(seen, coding._lengths([len(counts[n][e]) for e in seen], 24))) if seen else None
            of[n] = Book(book.values, tuple(bits.get(e) for e in range(len(book.bits)))) if seen else book
        books = Books(of, books.classes, books.class_bits)
        steps = {}
        for n, book in books.of.items():
            mean = lambda e: tuple(round(sum(round(t[d], 9) for t in counts[n][e]) / len(counts[n][e]) * 1024) / 1024 for d in range(2))  # noqa: E731, B023
            values = tuple(mean(e) if e in counts[n] else v for e, v in enumerate(book.values))
            if values != book.values:
                steps[n] = Book(values, book.bits)
        best = (books, *look(rows, books, price))
        for trial in ([steps] if len(steps) > 1 else []) + [{n: b} for n, b in steps.items()]:
            if all(best[0].of[n].values == b.values for n, b in trial.items()):
                continue
            tried = Books(best[0].of | trial, books.classes, books.class_bits)
            found = look(rows, tried, price)
            if found[1] < best[2]:
                best = (tried, *found)
        books, plans, cost, counts = best
    return costs, books


@pytest.fixture(scope="module")
def start():
    rng = random.Random(1)
    book = lambda n, s: [[round(rng.gauss(0, s), 3) for _ in range(2)] for _ in range(n)]
    return rd_training.flat_books({"a": book(6, 1), "b": book(4, 0.3), "never": [[90.0, 90.0]]}, [[], ["a"], ["a", "b"], ["never"]])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [[round(rng.gauss(0, 1), 4), round(rng.gauss(0, 1), 4)] for _ in range(300)]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k long, x array<double>").repartition(3)


def test_plans_and_bits(vectors, rows, start):
    weighted = vectors.selectExpr("k", "x", "double(1 + k % 3) as w")
    bias = (0.0, 0.01, 0.0, 0.0)
    for r in rd_training.planned(weighted, start, 0.05, weight="w", bias=bias).collect():
        cost, _, c, stages, bits = plan(rows[r.k], start, 0.05, 1 + r.k % 3, bias)
        assert (r["class"], r.bits, [(s.book, s.entry) for s in r.stages]) == (c, bits, [(n, e) for n, e, _ in stages]) and abs(r.cost - cost) < 2e-9


def test_training_replayed(vectors, rows, start):
    done = rd_training.train(vectors, ["k"], start, 0.05, 5)
    costs, books = replay(rows, start, 0.05, 5)
    assert done.costs == pytest.approx(costs, abs=1e-5) and done.books.of == books.of
    assert all(b <= a + 1e-6 for a, b in zip(done.costs, done.costs[1:])) and done.costs[-1] < done.costs[0]
    assert done.accepted >= 1 and done.books.of["never"] == start.of["never"]


def test_refined_bits_are_the_cost_of_what_is_emitted(spark, vectors, start):
    books, seen = rd_training.refined(vectors, ["k"], start, 0.05)
    plans = rd_training.planned(vectors, books, 0.05)
    emitted = plans.selectExpr("explode(stages) as s").selectExpr("s.book as book", "string(s.entry) as symbol").groupBy("book", "symbol").count().withColumnRenamed("count", "n")
    lengths = spark.createDataFrame([(n, str(e), b) for n, book in books.of.items() for e, b in enumerate(book.bits) if b is not None], "book string, symbol string, length int")
    assert sum(r.bits for r in coding.stream_cost(emitted, lengths).collect()) == seen.value_bits == plans.agg({"bits": "sum"}).first()[0]
    again = rd_training.relengthened(books, seen)
    assert again == books
    for name in ("a", "b"):
        assert sum(2.0**-b for b in books.of[name].bits if b is not None) <= 1


def test_no_rows(vectors, start):
    none = vectors.limit(0)
    done = rd_training.train(none, ["k"], start, 0.05, 3)
    assert done.books.of == start.of and set(done.costs) == {0.0}
