"""Vector quantisation: nearest entries, product lattices, residual cascades, centroid steps and scalar ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.signal import lit


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lit(0), lambda s, x: s + x)


def nearest_entry(vectors: DataFrame, book: list[list[float]], vector: str = "x", digits: int = 9) -> DataFrame:
    """vectors with entry and d2: the nearest row of a codebook, the lowest of equals after rounding to digits.

    The codebook is a parameter of a fixed size, so it is a literal: no join, no shuffle.
    """
    rows = F.array(*[F.array(*map(lit, row)) for row in book])
    costs = F.transform(rows, lambda row, e: F.struct(F.round(squared_distance(F.col(vector), row), digits).alias("d2"), e.alias("entry")))
    best = F.array_min(costs)
    return vectors.withColumn("_best", best).withColumns({"entry": F.col("_best.entry"), "d2": F.col("_best.d2")}).drop("_best")


def lattice_entry(vector: Column, low: float, step: float, levels: int) -> Column:
    """The entry of a product grid: each value to its nearest level, the lower of two equally near, as digits of one number."""
    digit = lambda v: F.greatest(F.least(F.ceil((v - lit(low)) / lit(step) - lit(0.5)), F.lit(levels - 1)), F.lit(0)).cast("long")
    places = F.transform(vector, lambda v, i: digit(v) * F.pow(lit(levels), i).cast("long"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda s, x: s + x)


def cascade(vectors: DataFrame, books: list[list[list[float]]], vector: str = "x", digits: int = 9) -> DataFrame:
    """vectors with entries, one for each stage, and error: each stage quantises what the stages before have left."""
    now = vectors.withColumn("_left", F.col(vector)).withColumn("entries", F.array().cast("array<int>"))
    for book in books:
        rows = F.array(*[F.array(*map(lit, row)) for row in book])
        now = nearest_entry(now, book, "_left", digits).withColumn("entries", F.concat("entries", F.array("entry"))).withColumn("_left", F.zip_with("_left", F.get(rows, F.col("entry")), lambda a, b: a - b)).drop("entry", "d2")
    return now.withColumn("error", F.aggregate(F.transform("_left", lambda v: v * v), lit(0), lambda s, x: s + x)).drop("_left")


def centroids(assigned: DataFrame, vector: str = "x", grid: float = 2.0**-10) -> DataFrame:
    """(entry, d, n, centre): the mean of each entry's vectors by dimension, on the grid of what a book can hold."""
    long = assigned.select("entry", F.posexplode(vector).alias("d", "v"))
    return long.groupBy("entry", "d").agg(F.count("*").alias("n"), (F.round(F.avg("v") / lit(grid)) * lit(grid)).alias("centre"))


def lloyd_levels(values: DataFrame, column: str, levels: int, most: int = 64) -> tuple[list[float], list[float]]:
    """(levels, mean squared error after each pass) of a scalar ladder: quantile seeds, then assign and average until no level moves.

    Each pass is one aggregation that brings back a row for each level, so the driver holds the ladder alone.
    """
    at = [(2 * k + 1) / (2 * levels) for k in range(levels)]
    seeds = values.agg(F.percentile_approx(column, at, 10_000).alias("q")).first().q
    ladder, errors = sorted(set(seeds or [])), []
    for _ in range(most):
        if not ladder:
            break
        near = F.array_min(F.array(*[F.struct(F.abs(F.col(column) - lit(v)).alias("d"), F.lit(k).alias("k")) for k, v in enumerate(ladder)]))
        found = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), near.alias("b")).groupBy("b.k").agg(F.avg("v").alias("v"), F.sum(F.col("b.d") * F.col("b.d")).alias("e"), F.count("*").alias("n")).collect()
        errors.append(sum(r.e for r in found) / sum(r.n for r in found))
        moved = list(ladder)
        for r in found:
            moved[r.k] = r.v
        if moved == ladder:
            break
        ladder = moved
    return ladder, errors


def design_codebook(vectors: DataFrame, entries: int, dims: int, vector: str = "x", passes: int = 6) -> tuple[list[list[float]], list[float]]:
    """(codebook, mean squared error after each pass): split the entries of most error in two, refine, and again until there are enough.

    A pass is one aggregation that brings back sums by entry, so the driver holds the codebook alone. An entry that no
    vector is nearest to moves beside the one of most error. Without vectors the codebook is empty.
    """
    start = vectors.agg(*[F.avg(F.get(vector, d)).alias(f"c{d}") for d in range(dims)]).first()
    if start[0] is None:
        return [], []
    book, errors = [[float(x) for x in start]], []
    while True:
        for _ in range(passes):
            near = nearest_entry(vectors, book, vector)
            sums = near.groupBy("entry").agg(F.count("*").alias("n"), F.sum("d2").alias("e"), *[F.avg(F.get(vector, d)).alias(f"c{d}") for d in range(dims)])
            cells = {r.entry: r for r in sums.collect()}
            errors.append(sum(r.e for r in cells.values()) / sum(r.n for r in cells.values()))
            worst = max(cells.values(), key=lambda r: (r.e, -r.entry))
            moved = [[float(cells[k][f"c{d}"]) for d in range(dims)] if k in cells else [float(worst[f"c{d}"]) + 1e-3 * (d + 1) for d in range(dims)] for k in range(len(book))]
            if moved == book:
                break
            book = moved
        if len(book) >= entries:
            return book, errors
        order = sorted(cells.values(), key=lambda r: (-r.e, r.entry))[: entries - len(book)]
        book += [[x + 1e-2 * (1 if d % 2 else -1) for d, x in enumerate(book[r.entry])] for r in order]
