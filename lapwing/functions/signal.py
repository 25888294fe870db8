"""Column functions of the signal engine. All arithmetic is in doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first level of the 256-level ladder, whose last is 1, and the ladder's size.
LADDER_LOW, LADDER_SIZE = 1.0649863e-07, 256
#: Fixed values of the masking model: decibels a Bark up and down, offset of noise, floor of energies, cap of squared ratios.
SPREAD_UP, SPREAD_DOWN, NOISE_OFFSET, ENERGY_FLOOR, RATIO_CAP = 10.0, 27.0, 5.5, 1e-30, 1e4


def lit(x: float) -> Column:
    return F.lit(float(x))


def let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often a lambda inside names it."""
    return F.get(F.transform(F.array(value), use), 0)


def ilog(x: int) -> int:
    """Bits of a whole number, 0 for 0 and below."""
    return x.bit_length() if x > 0 else 0


def bit_length(x: Column) -> Column:
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def bark(hz: Column) -> Column:
    return lit(13.1) * F.atan(lit(7.4e-4) * hz) + lit(2.24) * F.atan(lit(1.85e-8) * hz * hz) + lit(1e-4) * hz


def quiet_threshold(hz: Column) -> Column:
    """The threshold in quiet in decibels, between -30 and 120."""
    f = F.greatest(hz, lit(20)) / lit(1000)
    v = lit(3.64) * F.pow(f, lit(-0.8)) - lit(6.5) * F.exp(lit(-0.6) * (f - lit(3.3)) * (f - lit(3.3))) + lit(1e-3) * F.pow(f, lit(4))
    return F.least(F.greatest(v, lit(-30)), lit(120))


def bin_hz(k: Column, half: int, rate: float) -> Column:
    return (k + lit(0.5)) * lit(rate / (2 * half))


def slope(place: Column, n: float) -> Column:
    """The rising power-complementary slope of n places."""
    inner = F.sin((place + lit(0.5)) / lit(n) * lit(math.pi / 2))
    return F.sin(lit(math.pi / 2) * inner * inner)


def hybrid_window(i: Column, n: int, short: int, blockflag: Column, previous: Column, following: Column) -> Column:
    """The window at place i of n. A long block's side is a short block's slope where its neighbour on that side is short."""
    q, s = n // 4, short // 4
    short_left, short_right = blockflag & ~previous, blockflag & ~following
    rise = F.when(short_left, F.when(i < q - s, lit(0)).when(i < q + s, slope(i - (q - s), 2 * s)).otherwise(lit(1))).otherwise(slope(i, n / 2))
    fall = F.when(short_right, F.when(i < 3 * q - s, lit(1)).when(i < 3 * q + s, slope(lit(3 * q + s - 1) - i, 2 * s)).otherwise(lit(0))).otherwise(slope(lit(n - 1) - i, n / 2))
    return F.when(i < n // 2, rise).otherwise(fall)


def couple(left: Column, right: Column) -> Column:
    """(magnitude, angle) of a pair of channels."""
    magnitude = F.when((left > 0) == (left > right), left).otherwise(right)
    angle = F.when(left > 0, left - right).otherwise(right - left)
    return F.struct(magnitude.alias("magnitude"), angle.alias("angle"))


def uncouple(magnitude: Column, angle: Column) -> Column:
    """(left, right) again."""
    signed = F.when(magnitude > 0, angle).otherwise(-angle)
    left = F.when(angle > 0, magnitude).otherwise(magnitude + signed)
    right = F.when(angle > 0, magnitude - signed).otherwise(magnitude)
    return F.struct(left.alias("left"), right.alias("right"))


def ladder_level(place: Column) -> Column:
    """The value of a place on the ladder: geometric from LADDER_LOW to 1."""
    return F.exp((lit(1) - place / lit(LADDER_SIZE - 1)) * lit(math.log(LADDER_LOW)))


def ladder_place(x: Column) -> Column:
    """The nearest place on the ladder, the lower of two equally near."""
    at = F.greatest(lit(0), F.least(F.floor((lit(1) - F.ln(F.greatest(x, lit(LADDER_LOW))) / lit(math.log(LADDER_LOW))) * lit(LADDER_SIZE - 1)), lit(LADDER_SIZE - 2)))
    nearer = (ladder_level(at + 1) - x) < (x - ladder_level(at))
    return F.when(x >= 1, LADDER_SIZE - 1).otherwise(F.when(nearer, at + 1).otherwise(at)).cast("int")


def packed_float(bits: Column) -> Column:
    """The value of a 32-bit packed float: sign, 10 bits of exponent, 21 bits of significand."""
    value = bits.bitwiseAND(F.lit(0x1FFFFF)) * F.pow(lit(2), F.shiftright(bits, 21).bitwiseAND(F.lit(0x3FF)) - lit(788))
    return F.when(bits.bitwiseAND(F.lit(0x80000000)) != 0, -value).otherwise(value).cast("double")


def quality_law(q: Column) -> Column:
    """What quality sets: rate weight, threshold offset, posts and resolution divisor."""
    return F.struct(
        F.pow(lit(10), lit(-1.4) - lit(2.6) * q).alias("rate_weight"), F.least(lit(-12) + lit(24) * q, lit(6)).alias("offset_db"),
        (lit(8) + F.round(lit(24) * q)).cast("int").alias("posts"), (lit(192) * F.pow(lit(4), F.greatest((q - lit(0.7)) / lit(0.3), lit(0)))).alias("divisor"),
    )


def point_on_line(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    """The whole-numbered height at x of the line from (x0, y0) to (x1, y1); offsets round towards y0."""
    offset = F.floor(F.abs(y1 - y0) * (x - x0) / (x1 - x0))
    return F.when(y1 < y0, y0 - offset).otherwise(y0 + offset).cast("long")


def product_levels(entries: int, dims: int) -> int:
    """The most levels of each of dims dimensions whose product grid has no more than entries cells."""
    levels = max(0, round(entries ** (1 / dims)))
    while levels**dims > entries:
        levels -= 1
    while (levels + 1) ** dims <= entries:
        levels += 1
    return levels
