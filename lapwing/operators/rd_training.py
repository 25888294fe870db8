"""Training of residue books by rate and distortion: plans by real code lengths, lengths from what plans emit, and steps of the values.

A plan is a projection of each vector against books that are literals, so it neither joins nor shuffles; what a pass brings back is one row for
each entry of a book. The driver holds books, never vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.signal import let, lit
from lapwing.operators.coding import _lengths
from lapwing.operators.quantise import squared_distance
from lapwing.operators.scan import worked_out

#: The grid of what a book can hold, the digits by which costs are compared, and the longest codeword.
GRID, DIGITS, MOST_BITS = 2.0**-10, 9, 24


@dataclass(frozen=True)
class Book:
    """Entries' vectors, and the bits of each one's codeword, None for entries without one."""

    values: tuple[tuple[float, ...], ...]
    bits: tuple[int | None, ...]


@dataclass(frozen=True)
class Books:
    """Books by name, the cascade of names of each class, and the codewords of classes."""

    of: dict[str, Book]
    classes: tuple[tuple[str, ...], ...]
    class_bits: tuple[int, ...]


@dataclass
class Pass:
    """What a plan adds up to: cost of values (error and bits at their price), bits of values and of classes, counts and sums by entry, and a sum of hashes that tells plans apart."""

    cost: float
    value_bits: int
    class_bits: int
    plan: int
    class_counts: dict[int, int]
    entries: dict[str, dict[int, tuple[int, tuple[float, ...]]]]


@dataclass
class Outcome:
    books: Books
    costs: list[float] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    accepted: int = 0
    rejected: int = 0
    converged: bool = False


def flat_books(values: dict[str, list[list[float]]], classes: list[list[str]]) -> Books:
    """Books whose entries all have codewords of one length, as before any training."""
    length = lambda n: max(1, (n - 1).bit_length())
    books = {k: Book(tuple(map(tuple, v)), (length(len(v)),) * len(v)) for k, v in values.items()}
    return Books(books, tuple(map(tuple, classes)), (length(len(classes)),) * len(classes))


def _staged(left: Column, book: Book) -> Column:
    """(entry, bits, target, rest): the nearest entry that has a codeword, the lowest of equals, and what it leaves."""
    rows = F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(b).alias("bits"), F.array(*map(lit, v)).alias("v")) for e, (v, b) in enumerate(zip(book.values, book.bits)) if b is not None])
    near = F.array_min(F.transform(rows, lambda r: F.struct(F.round(squared_distance(left, r.v), DIGITS).alias("d2"), r.entry.alias("entry"), r.bits.alias("bits"), r.v.alias("v"))))
    return let(near, lambda n: F.struct(n.entry.alias("entry"), n.bits.alias("bits"), left.alias("target"), F.zip_with(left, n.v, lambda a, b: a - b).alias("rest")))


def planned(vectors: DataFrame, books: Books, price: float, vector: str = "x", weight: str | None = None, bias: tuple[float, ...] = ()) -> DataFrame:
    """vectors with class, stages (entry, bits, target), error, bits and cost: the class of least cost, then of fewest stages, then the first.

    A class's cost is its squared error times the weight of the vector, plus price times the bits of its entries' codewords, plus its bias. A book
    of a class that has no codeword left rules the class out.
    """
    w = lit(1) if weight is None else F.col(weight)
    of = vectors
    ways = []
    for c, names in enumerate(books.classes):
        if any(all(b is None for b in books.of[n].bits) for n in names):
            continue
        left, stages = F.col(vector), []
        for k, name in enumerate(names):
            of = worked_out(of, f"_c{c}s{k}", _staged(left, books.of[name]))
            stages.append(F.col(f"_c{c}s{k}"))
            left = stages[-1].rest
        error = w * F.aggregate(left, lit(0), lambda s, v: s + v * v)
        bits = sum((s.bits for s in stages), F.lit(0))
        kept = F.array(*[F.struct(F.lit(n).alias("book"), s.entry.alias("entry"), s.bits.alias("bits"), s.target.alias("target")) for n, s in zip(names, stages)]) if names else F.array().cast("array<struct<book:string,entry:int,bits:int,target:array<double>>>")
        extra = lit(bias[c]) if bias else lit(0)
        ways.append(F.struct(F.round(error + lit(price) * bits + extra, DIGITS).alias("cost"), F.lit(len(names)).alias("n"), F.lit(c).alias("class"), error.alias("error"), bits.alias("bits"), kept.alias("stages")))
    of = worked_out(of, "_best", F.array_min(F.array(*[F.struct(x["cost"].alias("cost"), x["n"].alias("n"), x["class"].alias("class")) for x in ways])))
    best = F.col("_best")
    pick = lambda name: F.coalesce(*[F.when(best["class"] == x["class"], x[name]) for x in ways])
    return of.select(*vectors.columns, best["class"].alias("class"), pick("stages").alias("stages"), pick("error").alias("error"), pick("bits").alias("bits"), best.cost.alias("cost"))


def measured(plans: DataFrame, keys: list[str], books: Books) -> Pass:
    """One aggregation of a plan. Sums are rounded, so that they don't depend on the order of partitions."""
    name = F.xxhash64(*keys, "class", F.transform("stages", lambda s: s.entry)).cast("decimal(38,0)")
    start = F.struct(F.lit(None).cast("string").alias("book"), F.col("class").alias("entry"), F.array(F.col("cost"), F.col("bits").cast("double")).alias("target"), name.alias("plan"))
    rows = plans.select(F.explode(F.concat(F.array(start), F.transform("stages", lambda s: F.struct(s.book.alias("book"), s.entry.alias("entry"), s.target.alias("target"), F.lit(0).cast("decimal(38,0)").alias("plan"))))).alias("r")).select("r.*")
    dims = max([2, *(len(b.values[0]) for b in books.of.values())])
    sums = [F.sum(F.round(F.get("target", d), DIGITS).cast("decimal(28,9)")).alias(f"s{d}") for d in range(dims)]
    found = rows.groupBy("book", "entry").agg(F.count("*").alias("n"), F.sum("plan").alias("plan"), *sums).collect()  # a row for each entry and class
    entries: dict[str, dict] = {n: {} for n in books.of}
    total = Pass(0.0, 0, 0, 0, {}, entries)
    for r in found:
        if r.book is None:
            total.cost += float(r.s0)
            total.value_bits += round(float(r.s1))
            total.plan += int(r.plan)
            total.class_counts[r.entry] = r.n
            total.class_bits += r.n * books.class_bits[r.entry]
        else:
            entries[r.book][r.entry] = (r.n, tuple(float(r[f"s{d}"]) for d in range(len(books.of[r.book].values[0]))))
    total.cost = round(total.cost, 6)
    return total


def relengthened(books: Books, seen: Pass) -> Books:
    """Books whose codewords are optimal for what was emitted: entries that weren't lose theirs, books that weren't used keep all, classes always keep one."""
    of = {}
    for name, book in books.of.items():
        counts = {e: n for e, (n, _) in sorted(seen.entries[name].items())}
        lengths = dict(zip(counts, _lengths(list(counts.values()), MOST_BITS))) if counts else {}
        of[name] = replace(book, bits=tuple(lengths.get(e) for e in range(len(book.bits)))) if counts else book
    classes = _lengths([seen.class_counts.get(c, 0) + 1 for c in range(len(books.classes))], MOST_BITS)
    return Books(of, books.classes, tuple(classes))


def moved(books: Books, seen: Pass) -> dict[str, Book]:
    """The books whose values change when each emitted entry goes to the mean of its targets, on the grid."""
    out = {}
    for name, book in books.of.items():
        values = list(book.values)
        for e, (n, sums) in seen.entries[name].items():
            values[e] = tuple(round(s / n / GRID) * GRID for s in sums)
        if tuple(values) != book.values:
            out[name] = replace(book, values=tuple(values))
    return out


def train(vectors: DataFrame, keys: list[str], books: Books, price: float, rounds: int, weight: str | None = None) -> Outcome:
    """Train books on vectors (keys, x): plan, give emitted entries their best codewords, then try moving values, and again.

    All books' moves together and each one's alone are tried by a plan of their own, as the stages of a cascade depend on one another; only
    what lowers the cost is kept. It ends when plans stay as they are, or after `rounds`.
    """
    done, before = Outcome(books), None
    look = lambda b: measured(planned(vectors, b, price, weight=weight), keys, b)
    seen = look(books)
    for _ in range(rounds):
        done.costs.append(seen.cost)
        done.bits.append(seen.value_bits + seen.class_bits)
        if seen.plan == before:
            done.converged = True
            break
        before = seen.plan
        lengthened = relengthened(done.books, seen)
        steps = moved(lengthened, seen)
        best, best_seen, adopted = lengthened, look(lengthened), False
        trials = ([steps] if len(steps) > 1 else []) + [{name: book} for name, book in steps.items()]
        for trial in trials:
            if all(best.of[n].values == b.values for n, b in trial.items()):
                continue
            tried = replace(best, of=best.of | trial)
            tried_seen = look(tried)
            if tried_seen.cost < best_seen.cost:
                best, best_seen, adopted = tried, tried_seen, True
        done.accepted += adopted
        done.rejected += not adopted
        done.books, seen = best, best_seen
    return done


def refined(vectors: DataFrame, keys: list[str], books: Books, price: float, rounds: int = 12, weight: str | None = None, bias: tuple[float, ...] = ()) -> tuple[Books, Pass]:
    """Books whose codewords fit the plan that they lead to: planned, counted and designed again until the plan stands still, or after `rounds`."""
    before = None
    for _ in range(rounds):
        seen = measured(planned(vectors, books, price, weight=weight, bias=bias), keys, books)
        if seen.plan == before:
            break
        before, books = seen.plan, relengthened(books, seen)
    else:
        seen = measured(planned(vectors, books, price, weight=weight, bias=bias), keys, books)
    return books, seen
