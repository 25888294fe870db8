"""Layouts of envelopes and residues: posts, distortion, resampling, factoring, coupling folds, packet assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.signal import couple, ladder_place, let, lit
from lapwing.operators import scan


def on_ladder(x: Column) -> Column:
    """An envelope as places on the decibel ladder."""
    return F.transform(x, lambda v: ladder_place(v).cast("double"))


def _line(a: Column, b: Column, at: Column) -> Column:
    return a.y + (b.y - a.y) * (at - a.x) / (b.x - a.x)


def plan_posts(x: Column, n: int, most: int, tolerance: float = 0.0) -> Column:
    """The posts of an envelope of n bins, beside its ends: one after another at the bin furthest from the lines
    between those there are, the first of equals, until `most` are placed or none is further off than tolerance."""

    def plan(places: Column) -> Column:
        point = lambda at, y: F.struct(at.cast("int").alias("x"), y.alias("y"))
        ends = F.array(point(F.lit(0), F.get(places, 0)), point(F.lit(n), F.get(places, n - 1)))

        def add(posts: Column, _: Column) -> Column:
            def off(i: Column) -> Column:
                before, after = F.filter(posts, lambda p: p.x < i), F.filter(posts, lambda p: p.x > i)
                error = F.abs(F.get(places, i) - _line(F.element_at(before, -1), F.get(after, 0), i))
                return F.struct(F.when(F.exists(posts, lambda p: p.x == i), lit(-1)).otherwise(error).alias("e"), (-i).alias("i"))

            worst = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), off))
            return let(worst, lambda w: F.when(w.e > lit(max(tolerance, 0.0)), F.array_sort(F.concat(posts, F.array(point(-w.i, F.get(places, -w.i)))))).otherwise(posts))

        inner = F.aggregate(F.sequence(F.lit(1), F.lit(most)), ends, add)
        return F.transform(F.filter(inner, lambda p: (p.x > 0) & (p.x < n)), lambda p: p.x)

    return let(on_ladder(x), plan)


def post_distortion(x: Column, n: int, posts: list[int]) -> Column:
    """The squared error of the lines between posts, on the ladder; posts may be in any order and repeat."""
    stops = sorted({0, n, *(p for p in posts if 0 < p < n)})
    low = {x: a for a, b in zip(stops, stops[1:]) for x in range(a, b)}
    high = {x: b for a, b in zip(stops, stops[1:]) for x in range(a, b)}
    lows, highs = F.array(*[F.lit(low[k]) for k in range(n)]), F.array(*[F.lit(high[k]) for k in range(n)])

    def error(places: Column) -> Column:
        def at(v: Column, k: Column) -> Column:
            a, b = F.get(lows, k), F.get(highs, k)
            y0, y1 = F.get(places, a), F.get(places, F.least(b, F.lit(n - 1)))
            d = v - (y0 + (y1 - y0) * (k - a) / (b - a))
            return d * d

        return F.aggregate(F.transform(places, at), lit(0), lambda s, e: s + e)

    return let(on_ladder(x), error)


def resampled(x: Column, source: int, size: int) -> Column:
    """An envelope of `source` bins at `size` evenly spaced places, linear between bins."""
    if source == size:
        return x

    def at(i: Column) -> Column:
        position = i * lit((source - 1) / max(1, size - 1))
        low = F.floor(position).cast("int")
        t = position - low
        return F.get(x, low) * (lit(1) - t) + F.get(x, F.least(low + 1, F.lit(source - 1))) * t

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def factored(spectrum: Column, floor: Column) -> Column:
    """Spectrum over floor, bin by bin: nothing over nothing is 0, something over nothing an error. A null floor gives no residue."""
    over = lambda v, f: F.when(f != 0, v / f).when(v == 0, lit(0)).otherwise(F.raise_error(F.lit("a bin that isn't 0 over a floor of 0")).cast("double"))
    return F.when(floor.isNull(), F.array().cast("array<double>")).otherwise(F.zip_with(spectrum, floor, over))


def unfactored(residue: Column, floor: Column, size: int) -> Column:
    """Floor times residue; zeros where there is no floor."""
    return F.coalesce(F.zip_with(residue, floor, lambda r, f: r * f), F.array_repeat(lit(0), size))


def spread_use(used: Column, steps: list[tuple[int, int]]) -> Column:
    """Which channels are used once coupled ones are: in order of steps, if one of a pair is, both are."""
    def step(a: int, b: int):
        either = lambda u: F.get(u, a) | F.get(u, b)
        return lambda u: F.transform(u, lambda x, i: F.when((i == a) | (i == b), either(u)).otherwise(x))

    for a, b in steps:
        used = let(used, step(a, b))
    return used


def pruned_steps(channels: Column, steps: list[tuple[int, int]], most: float) -> Column:
    """The numbers of the coupling steps worth taking, in order; a step that is taken changes the channels that later ones see."""
    energy = lambda c, part: F.aggregate(F.transform(c, lambda p: p[part] * p[part]), lit(0), lambda s, v: s + v)
    part = lambda c, name: F.transform(c, lambda p: p[name])

    def step(k: int, a: int, b: int):
        def decide(s: Column, c: Column) -> Column:
            m, n = energy(c, "magnitude"), energy(c, "angle")
            take = F.when(m > 0, n / m <= most).otherwise(n == 0)
            work = F.transform(s.work, lambda x, i: F.when(i == a, part(c, "magnitude")).when(i == b, part(c, "angle")).otherwise(x))
            return F.struct(F.when(take, work).otherwise(s.work).alias("work"), F.when(take, F.concat(s.kept, F.array(F.lit(k)))).otherwise(s.kept).alias("kept"))

        return lambda s: let(F.zip_with(F.get(s.work, a), F.get(s.work, b), couple), lambda c: decide(s, c))

    state = F.struct(channels.alias("work"), F.array().cast("array<int>").alias("kept"))
    for k, (a, b) in enumerate(steps):
        state = let(state, step(k, a, b))
    return state.kept


def residue_window(half: Column, rate: Column) -> Column:
    """Partition size of a residue, and where it ends: at 20 kHz, rounded up to whole partitions, within the half block."""
    size = F.when(half >= 512, 32).otherwise(16)
    nyquist = rate / lit(2)
    bins = F.ceil(half * lit(20_000) / nyquist)
    end = F.when(nyquist <= 20_000, half).otherwise(F.least(F.ceil(bins / size) * size, half))
    return F.struct(size.cast("int").alias("partition"), end.cast("long").alias("end"))


def gather_place(strided: Column, read: Column, j: Column, reads: int, dims: int) -> Column:
    """Where element j of a read lies in its partition: strided over the reads, or one after another."""
    return F.when(strided, read + j * reads).otherwise(read * dims + j)


def assembled(segments: DataFrame, key: str, ends: Column, *order: str) -> DataFrame:
    """segments with packet: the number, from 0, of the packet a segment belongs to; a packet's last segment ends it.

    Segments go by the columns of order, the first of which is a time or a number. Ends are counted in two levels, so no task holds a key.
    """
    placed = scan.numbered(segments.withColumn("_ends", ends), key, *order)
    return scan.running_total(placed, key, "i", F.col("_ends"), "packet").drop("_ends", "i")


def first_within(rows: DataFrame, keys: list[str], choice: str, error: str, target: float) -> DataFrame:
    """(keys, choice): the least choice whose error is within target, or else that of least error, the lower of equals."""
    hit = F.min(F.when(F.col(error) <= target, F.col(choice)))
    return rows.groupBy(*keys).agg(F.coalesce(hit, F.min_by(choice, F.struct(error, choice))).alias(choice))
