"""Join- and window-shaped operators: neighbours, segments, as-of fills, medians, residual choices, coupling gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.signal import lit, point_on_line
from lapwing.operators import scan


def earlier_neighbours(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with below and above: the place of the nearest smaller and nearest larger value among the rows before it in its group,
    the first of equals, and 0 where there is none. Groups are post lists of at most a few dozen rows: the join is within them."""
    before = rows.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    joined = rows.join(before, (F.col(key) == F.col("_k")) & (F.col("_o") < F.col(order)), "left")
    pick = lambda which, sign: F.coalesce(F.min_by("_o", F.when(which, F.struct(sign * F.col("_v"), F.col("_o")))), F.lit(0))
    return joined.groupBy(key, order, value).agg(pick(F.col("_v") < F.col(value), F.lit(-1)).alias("below"), pick(F.col("_v") > F.col(value), F.lit(1)).alias("above"))


def rendered_segments(posts: DataFrame) -> DataFrame:
    """(key, x, y) for every whole x from each post to the next: posts (key, x, y), x unique in a key. The last post ends it."""
    by = Window.partitionBy("key").orderBy("x")
    ends = posts.withColumn("x1", F.lead("x").over(by)).withColumn("y1", F.lead("y").over(by)).where("x1 is not null")
    spread = ends.select("key", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1", F.explode(F.sequence(F.col("x"), F.col("x1") - 1)).alias("at"))
    return spread.select("key", F.col("at").alias("x"), point_on_line(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("at")).alias("y"))


def forward_fill(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with filled: the last value that isn't null, or before the first one, that. order numbers a key's rows 0, 1, 2 ...; no task holds a key."""
    return scan.last_known(rows, key, order, value, "filled")


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the value at place floor(n / 2) from 0. Places are counted in two levels, so a key of very many rows is spread over tasks."""
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    placed = scan.numbered(rows.select(key, value), key, value).join(counts, F.col(key).eqNullSafe(F.col("_key")))
    return placed.where(F.col("i") == F.floor(F.col("_n") / 2)).select(key, F.col(value).alias("median"))


def stride_sample(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Every stride-th row in order of a key, the stride being the least that leaves no more than most rows.

    Places are ranks in two levels: within ranges of the key, a number, and the counts of the ranges before. The ranges' bounds are
    read once, so that both levels see the same ranges whatever is computed again. Null keys come first.
    """
    n = rows.count()
    stride = max(1, -(-n // most))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile(order, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if n else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    ranged = rows.withColumn("_part", part)
    ranged = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return ranged.join(offsets, "_part").where((F.col("_at") + F.col("_offset")) % stride == 0).drop("_part", "_at", "_offset")


def cheapest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of least order in each group; ties go on to the next column. One aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def coupling_energy(pairs: DataFrame, keys: list[str], magnitude: Column, angle: Column) -> DataFrame:
    """(keys, magnitude_energy, angle_energy, ratio): ratio 0 for silence, null where only the angle has energy."""
    of = pairs.groupBy(*keys).agg(F.sum(magnitude * magnitude).alias("magnitude_energy"), F.sum(angle * angle).alias("angle_energy"))
    m, a = F.col("magnitude_energy"), F.col("angle_energy")
    return of.withColumn("ratio", F.when(m > 0, a / m).when(a == 0, lit(0)))


def signal_to_noise(pairs: DataFrame, keys: list[str], reference: Column, decoded: Column) -> DataFrame:
    """(keys, snr_db) of paired samples; null where nothing differs."""
    error = reference - decoded
    of = pairs.groupBy(*keys).agg(F.sum(reference * reference).alias("s"), F.sum(error * error).alias("e"))
    return of.select(*keys, F.when(F.col("e") > 0, lit(10) * F.log10(F.col("s") / F.col("e"))).alias("snr_db"))
