"""Frames, lapped transforms and overlap-add. Frames are arrays: a transform needs no shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.signal import let, lit, slope
from lapwing.operators import scan


def _cosines(n: int) -> list[list[float]]:
    """The transform's matrix, a row for each coefficient: a constant of the plan, so no cosine is worked out for a frame."""
    return [[math.cos(math.pi / (2 * n) * (2 * i + 1 + n // 2) * (2 * k + 1)) for i in range(n)] for k in range(n // 2)]


def _times(matrix: list[list[float]], x: Column, scale: float) -> Column:
    rows = F.array(*[F.array(*map(lit, row)) for row in matrix])
    return let(x, lambda v: F.transform(rows, lambda row: lit(scale) * F.aggregate(F.zip_with(v, row, lambda a, c: a * c), lit(0), lambda s, y: s + y)))


def mdct(x: Column, n: int, scale: float = 1.0) -> Column:
    """n samples to n / 2 coefficients."""
    return _times(_cosines(n), x, scale)


def imdct(x: Column, n: int, scale: float = 1.0) -> Column:
    """n / 2 coefficients to n samples, with time aliasing that overlap-add cancels."""
    return _times([list(column) for column in zip(*_cosines(n))], x, scale)


def windowed(x: Column, n: int) -> Column:
    """A frame times the full window of n."""
    return F.transform(x, lambda v, i: v * F.when(i < n // 2, slope(i, n / 2)).otherwise(slope(n - 1 - i, n / 2)))


def hop_frames(samples: DataFrame, n: int) -> DataFrame:
    """(stream, f, x, held): frames of n at hops of n / 2, from (stream, i, x). Each sample lies in two frames; frame 0 begins
    half a frame early. Frames that samples don't fill have zeros there; held are a frame's samples alone, in no order. A frame is gathered, never a stream."""
    hop = n // 2
    at = F.explode(F.array(F.floor(F.col("i") / hop), F.floor(F.col("i") / hop) + 1)).alias("f")
    held = samples.select("stream", at, "i", "x").groupBy("stream", "f").agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") - (F.col("f") - 1) * hop).cast("int").alias("k"), "x"))).alias("m"))
    return held.select("stream", "f", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at("m", k), lit(0))).alias("x"), F.map_values("m").alias("held"))


def overlap_add(framed: DataFrame, n: int) -> DataFrame:
    """(stream, i, x): each frame's first half plus the last half of the frame before it. The first frame only primes.

    Frames are numbered without gaps in a stream. Each hands its last half on to the next number, where the two meet: no stream is put in order.
    """
    half = n // 2
    first, last = F.slice("x", 1, half), F.slice("x", half + 1, half)
    handed = framed.select("stream", F.explode(F.array(F.struct("f", first.alias("a"), F.lit(None).cast("array<double>").alias("b")), F.struct((F.col("f") + 1).alias("f"), F.lit(None).cast("array<double>").alias("a"), last.alias("b")))).alias("h")).select("stream", "h.*")
    met = handed.groupBy("stream", "f").agg(F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b")).where("a is not null and b is not null")
    return met.select("stream", "f", F.posexplode(F.zip_with("a", "b", lambda a, b: a + b)).alias("k", "x")).select("stream", ((F.col("f") - 1) * half + F.col("k")).alias("i"), "x")


def lap_granules(blocks: DataFrame) -> DataFrame:
    """blocks (stream, b, n) with granule: the running sum of (n before + n) / 4; the first block, number 0, is at 0."""
    return scan.running_steps(blocks, "stream", "b", "n", lambda before, n: (before + n) / 4, "granule")


def transients(samples: DataFrame, block: int = 64, subframes: int = 16) -> DataFrame:
    """(stream, block, n, peak_energy, mean_energy, peak_to_mean) of blocks of samples, in sub-frames of which the last takes the rest.

    Blocks shorter than the number of sub-frames have one sub-frame for each sample. A silent block's ratio is 1.
    """
    placed = samples.withColumn("block", F.floor(F.col("i") / block)).withColumn("at", F.col("i") % block)
    size = placed.groupBy("stream", "block").agg(F.count("*").alias("n"))
    placed = placed.join(size, ["stream", "block"])
    count = F.least(F.lit(subframes), F.col("n"))
    part = F.least(F.floor(F.col("at") / F.floor(F.col("n") / count)), count - 1)
    energy = placed.groupBy("stream", "block", "n", part.alias("part")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    of = energy.groupBy("stream", "block", "n").agg(F.max("e").alias("peak_energy"), (F.sum("e") / F.least(F.lit(subframes), F.col("n"))).alias("mean_energy"))
    return of.withColumn("peak_to_mean", F.when(F.col("mean_energy") == 0, lit(1)).otherwise(F.col("peak_energy") / F.col("mean_energy")))


def block_schedule(samples: DataFrame, short: int = 64, long: int = 128, subframes: int = 16, peak: float = 3.0, rise: float = 4.0, stretch: int = 512, silence_short: bool = False) -> DataFrame:
    """(stream, b, long, granule): block sizes that follow the signal. A block at g is short if the energy ahead of it is concentrated,
    or rises over the mean ahead of the block decided before; each granule depends on the size decided there. Silence isn't
    concentrated, unless silence_short says so.

    Energies ahead of every place at which a block can start are aggregated first. What is decided at a place depends on two things
    only, the sizes of the last two blocks, so a stretch of places is a map from the few states in which it can be entered to those in which it is left.
    Maps are made stretch by stretch, composed along the stream (scan.entered), and each stretch then writes its blocks from its own entry. No
    task holds a stream. Samples are numbered 0, 1, 2 ... in a stream; stretch is in places, a quarter of a short block apart.
    """
    grid, wide = short // 4, long // short
    starts = F.explode(F.sequence(F.greatest(F.floor((F.col("i") - long) / grid) + 1, lit(0)).cast("long"), F.floor(F.col("i") / grid).cast("long"))).alias("g")
    ahead = samples.select("stream", starts, "i", "x").withColumn("g", F.col("g") * grid)
    n = ahead.groupBy("stream", "g").agg(F.count("*").alias("n"))
    count = F.least(F.lit(subframes), F.col("n"))
    part = F.least(F.floor((F.col("i") - F.col("g")) / F.floor(F.col("n") / count)), count - 1)
    e = ahead.join(n, ["stream", "g"]).groupBy("stream", "g", "n", part.alias("part")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    of = e.groupBy("stream", "g", "n").agg(F.max("e").alias("peak"), (F.sum("e") / F.least(F.lit(subframes), F.col("n"))).alias("mean"))

    # each stretch's places, and the last ones of the stretch before: means that its first blocks compare with
    most = 2 * wide
    place = (F.col("g") / grid).cast("long")
    of = of.select("stream", place.alias("p"), "peak", "mean").withColumn("own", F.floor(F.col("p") / stretch))
    both = F.when(F.col("p") % stretch >= stretch - most, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))
    held = of.select("stream", F.explode(both).alias("part"), "p", "peak", "mean").groupBy("stream", "part").agg(F.array_sort(F.collect_list(F.struct("p", "peak", "mean"))).alias("a"))
    held = held.where(F.element_at("a", -1).p >= F.col("part") * stretch)

    def long_after(here: Column, before: Column | None) -> Column:
        concentrated = F.when(here.mean == 0, F.lit(silence_short)).otherwise(here.peak / here.mean > peak)
        risen = F.lit(False) if before is None else F.coalesce(here.peak > lit(rise) * F.greatest(before, lit(2.2250738585072014e-308)), F.lit(False))
        return ~(concentrated | risen)

    # what would be decided at each place if the block before stood there too (0) or any number of places earlier, and if there was none
    back = [0, 2, 1 + wide, 2 * wide]
    skipped = (F.col("part") * stretch - F.get("a", 0).p).cast("int")

    def decided(here: Column, k: Column) -> Column:
        mean = lambda d: F.get(F.col("a"), k + skipped - d).mean
        return F.array(*[long_after(here, mean(d)) for d in back], long_after(here, None))

    held = held.select("stream", "part", F.transform(F.expr(f"slice(a, cast(part * {stretch} - a[0].p as int) + 1, {stretch})"), decided).alias("c"))
    units = lambda f: F.when(f, wide).otherwise(1)
    first = 4 * most

    def walked(entry: Column, state: Callable, keep: Callable) -> Column:
        """From an entry (place, sizes of the last two blocks as bits; or `first`) until the stretch is left."""

        def step(s: Column, _: Column) -> Column:
            def move(c: Column) -> Column:
                flag = F.when(s.opening, F.get(c, 0)).otherwise(F.when(s.before & s.long, F.get(c, 3)).when(s.before | s.long, F.get(c, 2)).otherwise(F.get(c, 1)))
                return let(flag, lambda f: keep(s, state(s.p + units(s.long) + units(f), s.long, f, F.lit(False))))

            return F.when(s.p < F.size("c"), let(F.get(F.col("c"), s.p), move)).otherwise(s)

        opening = entry == first
        start = state(F.when(opening, 0).otherwise(F.floor(entry / 4)), F.when(opening, F.lit(False)).otherwise(entry % 4 >= 2), F.when(opening, F.get(F.get(F.col("c"), 0), 4)).otherwise(entry % 2 == 1), opening)
        return F.aggregate(F.sequence(F.lit(1), F.lit(stretch // 2 + 1)), keep(None, start), step)

    def state(p: Column, before: Column, long_: Column, opening: Column) -> list[Column]:
        return [p.cast("int").alias("p"), before.alias("before"), long_.alias("long"), opening.alias("opening")]

    counting = lambda s, now: F.struct(*now, (F.lit(0).cast("long") if s is None else s.n + 1).alias("n"))
    left = lambda s: F.struct(((s.p - stretch) * 4 + s.before.cast("int") * 2 + s.long.cast("int")).alias("exit"), s.n.alias("n"))
    maps = held.withColumn("map", F.transform(F.sequence(F.lit(0), F.lit(first)), lambda k: let(walked(k, state, counting), left)))
    inside = scan.entered(maps, "stream", first + 1, first)

    nothing = F.array().cast("array<struct<long:boolean,p:int>>")
    noting = lambda s, now: F.struct(*now, (nothing if s is None else F.concat(s.out, F.array(F.struct(now[2], now[0])))).alias("out"))
    written = inside.select("stream", "part", "before", F.get(F.get("c", 0), 4).alias("opens"), walked(F.col("entry"), state, noting).out.alias("out"))
    rows = written.select("stream", "part", "before", F.posexplode("out").alias("k", "o")).select("stream", (F.col("before") + F.col("k") + 1).cast("int").alias("b"), F.col("o.long").alias("long"), ((F.col("part") * stretch + F.col("o.p")) * grid).cast("long").alias("granule"))
    openings = written.where("part = 0").select("stream", F.lit(0).alias("b"), F.col("opens").alias("long"), F.lit(0).cast("long").alias("granule"))
    return openings.unionByName(rows)
