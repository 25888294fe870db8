"""Entries back to vectors, what cascades saw, prediction filters, posts by prediction, choosers and book checks. All column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.signal import let, lit, point_on_line


def running(values: Column, summed: Column) -> Column:
    """values, or where summed is true each with all before it added."""
    def add(a: Column, v: Column) -> Column:
        now = v + F.when(summed & (F.size(a) > 0), F.element_at(a, -1)).otherwise(lit(0))
        return F.concat(a, F.array(now))

    return F.when(summed, F.aggregate(values, F.array().cast("array<double>"), lambda a, v: F.when(F.size(a) > 0, add(a, v)).otherwise(F.array(v)))).otherwise(values)


def lattice_vector(entry: Column, low: float, step: float, levels: int, dims: int, summed: Column) -> Column:
    """The vector of an entry of a product grid, whose base-`levels` digits, least first, are its places."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.floor(entry / F.pow(lit(levels), i)).cast("long") % levels)
    return running(F.transform(digits, lambda d: lit(low) + lit(step) * d), summed)


def table_vector(entry: Column, table: list[list[int]], low: float, step: float, summed: Column) -> Column:
    """The vector of an entry of a table of multiplicands; null for an entry that isn't there."""
    rows = F.array(*[F.array(*map(F.lit, r)) for r in table])
    return running(F.transform(F.get(rows, entry), lambda m: lit(low) + lit(step) * m), summed)


def replay(vector: Column, entries: Column, books: list[list[list[float]]]) -> Column:
    """What each stage of a cascade was given: an array of (stage, entry, target), by taking the entries' vectors off one after the other."""
    left, out = vector, []
    for k, book in enumerate(books):
        rows = F.array(*[F.array(*map(lit, r)) for r in book])
        out.append(F.struct(F.lit(k).alias("stage"), F.get(entries, k).alias("entry"), left.alias("target")))
        left = F.zip_with(left, F.get(rows, F.get(entries, k)), lambda a, b: a - b)
    return F.array(*out)


def prediction_filter(r: Column, order: int) -> Column:
    """(a, error): the coefficients 1..order that predict a process of autocorrelation r, and the variance left; null if r[0] <= 0 or it fails to fall within (0, r[0]]."""
    def stage(s: Column, i: Column) -> Column:
        acc = F.aggregate(F.sequence(F.lit(0), F.size(s.a)), lit(0), lambda t, j: t + F.when(j == F.size(s.a), F.get(r, i)).otherwise(F.get(s.a, j) * F.get(r, i - 1 - j)))

        def grown(k: Column) -> Column:
            a = F.transform(s.a, lambda v, j: v + k * F.get(s.a, F.size(s.a) - 1 - j))
            return F.struct(F.concat(a, F.array(k)).alias("a"), (s.error * (lit(1) - k * k)).alias("error"))

        return F.when(s.error > 0, let(-acc / s.error, grown))

    start = F.struct(F.array().cast("array<double>").alias("a"), F.get(r, 0).alias("error"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, stage)
    return let(done, lambda s: F.when(s.error > 0, s))


def spectral_weight(angles: Column, order: int, size: int, at: Column) -> Column:
    """One over the root of the two products of a line-spectral envelope, at a place of its frequency map of `size` places."""
    w = F.cos(lit(math.pi) * at / lit(size))
    product = lambda first, n, start: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>"), start, lambda p, j: p * 4 * F.pow(F.cos(F.get(angles, 2 * j + first)) - w, lit(2)))
    if order % 2:
        p, q = product(1, (order - 1) // 2, lit(1) - w * w), product(0, order // 2 + 1, lit(0.25))
    else:
        p, q = product(1, order // 2, (lit(1) - w) / 2), product(0, order // 2, (lit(1) + w) / 2)
    return lit(1) / F.greatest(F.sqrt(F.greatest(p + q, lit(0))), lit(1.17549435e-38))


def all_posts(inner: list[int], bits: int) -> list[int]:
    """The places of all posts: both ends, then the inner ones as listed."""
    return [0, 1 << bits, *inner]


def _rooms(predicted: Column, size: int):
    high, low = F.lit(size) - predicted, predicted
    return high, low, 2 * F.least(high, low)


def post_value(y: Column, predicted: Column, size: int) -> Column:
    """The value that codes post y, given its prediction: small differences alternate in sign, those beyond the smaller room go on one way."""
    high, low, room = _rooms(predicted, size)
    d = y - predicted
    beyond = F.when(high > low, y).otherwise(F.lit(size) - 1 - y)
    near = F.when(d >= 0, 2 * d).otherwise(-2 * d - 1)
    return F.when(d == 0, F.lit(0)).when(((d > 0) & (2 * d >= room)) | ((d < 0) & (-2 * d - 1 >= room)), beyond).otherwise(near).cast("int")


def post_height(value: Column, predicted: Column, size: int) -> Column:
    """The post that a value codes: the inverse of post_value."""
    high, low, room = _rooms(predicted, size)
    far = F.when(high > low, value - low + predicted).otherwise(predicted - value + high - 1)
    near = F.when(value % 2 == 1, predicted - F.floor((value + 1) / 2)).otherwise(predicted + F.floor(value / 2))
    return F.when(value == 0, predicted).when(value >= room, far).otherwise(near).cast("int")


def coded_posts(heights: dict[int, Column], inner: list[int], bits: int, size: int) -> Column:
    """An array of (place, predicted, value, height) of the inner posts: each predicted on the line between its neighbours listed before it."""
    places, out = all_posts(inner, bits), []
    for k, x in enumerate(places[2:], 2):
        low, high = max(p for p in places[:k] if p < x), min(p for p in places[:k] if p > x)
        predicted = point_on_line(F.lit(low), heights[low], F.lit(high), heights[high], F.lit(x)).cast("int")
        value = post_value(heights[x], predicted, size)
        out.append(F.struct(F.lit(x).alias("x"), predicted.alias("predicted"), value.alias("value"), post_height(value, predicted, size).alias("height")))
    return F.array(*out)


def packed_bits(x: Column) -> Column:
    """The 32 bits of a packed float of x, the significand as short as it can be; null for what no such float holds."""
    size = F.abs(x)
    scale = F.floor(F.log2(size)).cast("int")
    whole = size * F.pow(lit(2), lit(20) - scale)  # 21 bits at most, if it is whole
    m = F.round(whole).cast("long")
    odd = m.bitwiseAND(-m)
    exponent = scale - 20 + F.log2(odd.cast("double")).cast("int") + 788
    fits = (whole == m) & (exponent >= 0) & (exponent <= 1023)
    bits = F.when(x < 0, F.lit(0x80000000)).otherwise(F.lit(0)) + F.shiftleft(exponent.cast("long"), 21) + (m / odd).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when(fits, bits)


def accepted(targets: DataFrame, leaves: DataFrame, empty: int) -> DataFrame:
    """targets (slot, y) with accepted: whether the slot's book holds y (leaves: slot, y, distinct). The slot `empty` has no book and holds 0 only."""
    found = targets.join(leaves.select("slot", "y").distinct().withColumn("_in", F.lit(True)), ["slot", "y"], "left")
    return found.withColumn("accepted", F.when(F.col("slot") == empty, F.col("y") == 0).otherwise(F.col("_in").isNotNull())).drop("_in")


def smallest_choice(fits: Column, choices: list[int], bits: int) -> Column:
    """The smallest choice each of whose digits, `bits` bits a target, names a slot that takes the target; fits has a row of flags, one a slot, for each target."""
    digit = lambda c, j: F.floor(c / F.pow(lit(2), j * bits)).cast("int") % F.lit(1 << bits)
    every = lambda c: F.forall(F.transform(fits, lambda row, j: F.get(row, digit(c, j))), lambda ok: ok)
    return F.get(F.filter(F.array(*[F.lit(c) for c in sorted(choices)]), every), 0)


def cheapest_length(costs: list[Column]) -> Column:
    """The place of the least of costs, the first of equals."""
    return F.array_min(F.array(*[F.struct(c.alias("cost"), F.lit(k).alias("k")) for k, c in enumerate(costs)])).k
