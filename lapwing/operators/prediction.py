"""Prediction from what a decoder will have: coefficients in a closed loop, posts from rebuilt neighbours, and the choice of books for posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.signal import let, lit, point_on_line
from lapwing.operators.decode import post_height, post_value
from lapwing.operators.quantise import squared_distance

DIGITS = 9


def _row(**fields: Column) -> Column:
    """A struct whose names hold inside nested lambdas too, where aliases may be lost."""
    return F.named_struct(*[c for name, value in fields.items() for c in (F.lit(name), value)])


def _cut(values: Column, dims: int) -> Column:
    """values in vectors of dims, the last one filled up with its last value."""
    n = F.size(values)
    filled = F.concat(values, F.array_repeat(F.element_at(values, -1), F.pmod(-n, F.lit(dims))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / dims).cast("int") - 1), lambda v: F.slice(filled, v * dims + 1, dims))).otherwise(F.array().cast("array<array<double>>"))


def coded_in_loop(values: Column, book: Sequence[Sequence[float]], dims: int, closed: bool = True) -> Column:
    """An array of (entry, rebuilt), one for each vector of dims values: the nearest entry to what a vector lies above the last value before it.

    In the closed loop that last value is the rebuilt one, which a decoder has too, so errors don't add up; in the open loop it is the exact one,
    though a decoder can only add entries up. The first vector starts from 0; of equally near entries the lowest is taken.
    """
    rows = F.array(*[F.struct(F.lit(e).alias("entry"), F.array(*map(lit, v)).alias("v")) for e, v in enumerate(book)])

    def step(s: Column, v: Column) -> Column:
        target = F.transform(v, lambda x: x - (s.last if closed else s.exact))
        near = let(target, lambda t: F.array_min(F.transform(rows, lambda r: _row(d2=F.round(squared_distance(t, r.v), DIGITS), entry=r.entry, v=r.v))))

        def taken(n: Column) -> Column:
            rebuilt = F.transform(n.v, lambda x: x + s.last)
            return _row(last=F.element_at(n.v, -1) + s.last, exact=F.element_at(v, -1), out=F.concat(s.out, F.array(_row(entry=n.entry, rebuilt=rebuilt))))

        return let(near, taken)

    start = F.struct(lit(0).alias("last"), lit(0).alias("exact"), F.array().cast("array<struct<entry:int,rebuilt:array<double>>>").alias("out"))
    return F.aggregate(_cut(values, dims), start, step).out


def rebuilt_from(entries: Column, book: Sequence[Sequence[float]], n: Column) -> Column:
    """The n values that entries stand for: each vector above the last value of the one before."""
    rows = F.array(*[F.array(*map(lit, v)) for v in book])
    step = lambda s, e: let(F.transform(F.get(rows, e), lambda x: x + F.coalesce(F.element_at(F.concat(F.array(lit(0)), s), -1), lit(0))), lambda v: F.concat(s, v))
    return F.slice(F.aggregate(entries, F.array().cast("array<double>"), step), F.lit(1), n)


_POST = "array<struct<x:int,y:int,predicted:int,value:int,coded:boolean>>"


def _predicted(done: Column, x: Column) -> Column:
    """The height at x on the line between its nearest neighbours on both sides among the posts done."""
    low = F.array_max(F.filter(F.transform(done, lambda p: F.when(p.x < x, _row(x=p.x, y=p.y))), lambda p: p.isNotNull()))
    high = F.array_min(F.filter(F.transform(done, lambda p: F.when(p.x > x, _row(x=p.x, y=p.y))), lambda p: p.isNotNull()))
    return let(_row(l=low, h=high), lambda n: point_on_line(n.l.x, n.l.y, n.h.x, n.h.y, x).cast("int"))


def _posts(xs: Column, given: Column, size: int, each) -> Column:
    """xs and given in step, the first two as they are; then each(predicted, given) has the y, value and coded of a post."""
    pairs = F.zip_with(xs, given, lambda x, g: _row(x=x, g=g))
    post = lambda x, y, predicted, value, coded: _row(x=x.cast("int"), y=y.cast("int"), predicted=predicted.cast("int"), value=value.cast("int"), coded=coded)
    ends = F.transform(F.slice(pairs, 1, 2), lambda p: post(p["x"], p["g"], p["g"], p["g"], F.lit(True)))

    def step(done: Column, p: Column) -> Column:
        return let(_predicted(done, p["x"]), lambda q: let(_row(**each(q, p["g"])), lambda e: F.concat(done, F.array(post(p["x"], e["y"], q, e["value"], e["coded"])))))

    out = F.aggregate(F.slice(pairs, F.lit(3), F.greatest(F.size(pairs) - 2, F.lit(0))), ends.cast(_POST), lambda s, p: step(s, p).cast(_POST))
    inside = F.forall(F.filter(given, lambda y: y.isNotNull()), lambda y: (y >= 0) & (y < size)) & F.get(given, 0).isNotNull() & F.get(given, 1).isNotNull()
    return F.when(inside & (F.size(xs) == F.size(given)), out)


def planned_posts(xs: Column, ys: Column, size: int) -> Column:
    """An array of (x, y, predicted, value, coded) of posts at xs with heights ys below size: both ends, then the others in the order listed.

    Each post is predicted on the line between its neighbours listed before it, as they come out: a post whose height is null is left out
    and stands at its prediction, and later ones are predicted from there. A value of 0 says that a post is at its prediction. Null
    if an end is null, a height is outside 0 to size - 1, or lists differ in length.
    """
    return _posts(xs, ys, size, lambda q, y: {"y": F.coalesce(y, q), "value": F.when(y.isNull(), 0).otherwise(post_value(y, q, size)), "coded": y.isNotNull() & (y != q)})


def rebuilt_posts(xs: Column, values: Column, size: int) -> Column:
    """The same posts from their values alone."""
    return _posts(xs, values, size, lambda q, v: {"y": post_height(v, q, size), "value": v, "coded": v != 0})


def fitting_choices(choices: Sequence[int], bits: int, places: int) -> list[list[int]]:
    """For each place and each set of slots (as bits): which choices have a digit there that names one of the slots, as bits in order of choices.

    A digit has `bits` bits, the lowest first. At most 63 choices.
    """
    if len(choices) > 63:
        raise ValueError("at most 63 choices fit in one number")
    digit = lambda c, j: (c >> (j * bits)) & ((1 << bits) - 1)
    return [[sum(1 << k for k, c in enumerate(sorted(choices)) if slots >> digit(c, j) & 1) for slots in range(1 << (1 << bits))] for j in range(places)]


def choice_mask(place: Column, slots: Column, choices: Sequence[int], bits: int) -> Column:
    """The choices that suit one target, as bits: slots says which of the slots take it."""
    places = max(choices, default=0).bit_length() // bits + 1  # beyond these every digit is 0
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in fitting_choices(choices, bits, places)])
    return F.get(F.get(table, F.least(place, F.lit(places - 1)).cast("int")), slots.cast("int"))


def first_choice(mask: Column, choices: Sequence[int]) -> Column:
    """The smallest choice of a mask; null for none."""
    lowest = F.bit_count(mask.bitwiseAND(-mask) - 1)
    return F.when(mask != 0, F.get(F.array(*[F.lit(c) for c in sorted(choices)]), lowest.cast("int")))


def chosen(targets: DataFrame, keys: list[str], leaves: DataFrame, choices: Sequence[int], bits: int, empty: int | None = None) -> DataFrame:
    """(keys, choice) of (keys, j, y): the smallest choice whose digit at each place j names a slot whose book (leaves: slot, y) holds y; null where none does.

    The slot `empty` has no book and takes 0 only. Targets are reduced to bits and combined by bit_and, so a group may have any number of them.
    """
    held = leaves.select("slot", "y").distinct().groupBy("y").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("slot").cast("int"))).alias("_slots"))
    slots = F.coalesce("_slots", F.lit(0))
    if empty is not None:
        slots = slots.bitwiseAND(F.lit(~(1 << empty))) + F.when(F.col("y") == 0, 1 << empty).otherwise(0)
    of = targets.join(held, "y", "left").withColumn("_mask", choice_mask(F.col("j"), slots, choices, bits))
    return of.groupBy(*keys).agg(first_choice(F.bit_and("_mask"), choices).alias("choice"))
