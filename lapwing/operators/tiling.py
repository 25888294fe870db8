"""Tilings of post lists by classes of given sizes, and whole envelope headers built on them. Column expressions: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapwing.functions.signal import bit_length, let
from lapwing.operators.layout import plan_posts

#: Fixed values of the format: sizes of a class, classes, and partitions of a header.
MOST_SIZE, MOST_CLASSES, MOST_PARTITIONS = 8, 16, 31


def tiling(posts: Column, sizes: Column) -> Column:
    """The classes, in order, whose sizes add up to posts in the fewest partitions; null where there is no such list.

    sizes is an array, the size of each class. A table of least counts is filled place by place, with the class that was last, the first
    of equals; the classes are then read back from its end. Null as well: posts below 1, sizes outside 1 to 8, no class or
    over 16, and tilings of over 31 partitions.
    """
    cell = lambda n, c: F.struct(n.cast("int").alias("n"), c.cast("int").alias("c"))

    def filled(table: Column, r: Column) -> Column:
        reach = lambda d: F.when((d <= r) & (d >= 1), F.get(table, r - d).n)
        ways = F.transform(sizes, lambda d, c: F.when(reach(d).isNotNull(), cell(reach(d) + 1, c)))
        return F.concat(table, F.array(F.coalesce(F.array_min(ways), cell(F.lit(None), F.lit(None)))))

    table = F.aggregate(F.sequence(F.lit(1), F.greatest(posts, F.lit(1))), F.array(cell(F.lit(0), F.lit(None))), filled)

    def read_back(table: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            c = F.get(table, s.left).c
            return F.struct((s.left - F.get(sizes, c)).alias("left"), F.concat(F.array(c), s.classes).alias("classes"))

        n = F.get(table, posts).n
        start = F.struct(posts.cast("int").alias("left"), F.array().cast("array<int>").alias("classes"))
        return F.when((n >= 1) & (n <= MOST_PARTITIONS), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step).classes)

    legal = (posts >= 1) & (F.size(sizes) >= 1) & (F.size(sizes) <= MOST_CLASSES) & F.forall(sizes, lambda d: d.isNotNull() & (d >= 1) & (d <= MOST_SIZE))
    return F.when(legal, let(table, read_back))


def owned_posts(classes: Column, sizes: Column, posts: Column) -> Column:
    """The posts of each partition, in ascending order: a partition of size d owns the next d."""

    def deal(s: Column, c: Column) -> Column:
        d = F.get(sizes, c)
        return F.struct((s.done + d).alias("done"), F.concat(s.parts, F.array(F.slice(posts, s.done + 1, d))).alias("parts"))

    start = F.struct(F.lit(0).alias("done"), F.array().cast("array<array<int>>").alias("parts"))
    return F.aggregate(classes, start, deal).parts


def envelope_header(x: Column, n: int, most: int, tolerance: float, sizes: Column) -> Column:
    """(range_bits, posts, classes, parts) of an envelope of n bins: posts by refinement, tiled by classes of the given sizes.

    An envelope that needs no inner post has no partition, which is a legal header. Where the posts can't be tiled the header is null.
    """

    def header(posts: Column) -> Column:
        some = F.size(posts) > 0

        def built(classes: Column) -> Column:
            whole = F.struct(F.lit((n - 1).bit_length()).alias("range_bits"), posts.alias("posts"), classes.alias("classes"), owned_posts(classes, sizes, posts).alias("parts"))
            return F.when(classes.isNotNull(), whole)

        return let(F.when(some, tiling(F.size(posts), sizes)).otherwise(F.array().cast("array<int>")), built)

    return let(plan_posts(x, n, most, tolerance), header)


def range_bits(n: Column) -> Column:
    """The bits that the places 0 to n - 1 take."""
    return bit_length(n - 1).cast("int")
