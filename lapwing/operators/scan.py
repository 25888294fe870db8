"""Scans along streams of any length, in two levels: summaries of stretches, a scan over these, and the same scan inside each stretch.

A stream may hold a third of all rows, so nothing here sorts, windows or gathers a whole stream. Where places are numbered, a stretch is
CHUNK places; where they aren't yet, stretches are ranges of time with about equally many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.signal import let, lit

#: Places of a stretch.
CHUNK = 4096
_BEFORE = (Window.unboundedPreceding, -1)


def worked_out(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that later columns read as a value: a generator of one row keeps the optimizer from writing its expression into them."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _met(rows: DataFrame, per: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with per by keys, null keys being equal to one another."""
    names = {k: f"_{k}_of" for k in keys}
    of = per.select(*[F.col(c).alias(names.get(c, c)) for c in per.columns])
    here = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(of, here, how).drop(*names.values())


def _carried(rows: DataFrame, keys: list[str], summaries: list[Column], carry: Callable[..., list[Column]]) -> DataFrame:
    """rows (with their stretch in _chunk) joined with what carry makes of the stretches' summaries, one row a stretch, in order."""
    per = rows.groupBy(*keys, "_chunk").agg(*summaries)
    return _met(rows, per.select(*keys, "_chunk", *carry(Window.partitionBy(*keys).orderBy("_chunk"))), [*keys, "_chunk"])


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with i: 0, 1, 2 ... along each key's rows, in the order of the given columns, the first of which is a time or a number.

    Stretches are ranges of the first column between quantiles of all rows, read once, so that both levels see the same ones. Nulls come first.
    """
    at = F.col(order[0])
    number = (at.cast("timestamp") if dict(rows.dtypes)[order[0]].startswith("timestamp") else at).cast("double")
    placed = rows.withColumn("_number", number)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(placed.approxQuantile("_number", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))))
    chunk = F.size(F.filter(F.array(*map(lit, bounds)), lambda b: b <= F.col("_number"))) if bounds else F.lit(0)
    placed = worked_out(placed, "_chunk", F.coalesce(chunk, F.lit(0))).drop("_number")
    ahead = _carried(placed, [key], [F.count("*").alias("_n")], lambda w: [F.coalesce(F.sum("_n").over(w.rowsBetween(*_BEFORE)), F.lit(0)).alias("_offset")])
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    return ahead.withColumn("i", (F.row_number().over(inside) - 1 + F.col("_offset")).cast("long")).drop("_chunk", "_offset")


def decaying_maximum(rows: DataFrame, key: str, order: str, value: str, post: float, pre: float, name: str) -> DataFrame:
    """rows with name: the largest of what still lasts of a value, itself or before, times post a step, where each value counts as at least
    the next one times pre. order numbers a key's rows 0, 1, 2 ...; maxima are of logarithms, so that long runs neither grow nor vanish.
    """
    fade = F.ln(lit(post))
    place = F.col(order).cast("double") + 1
    placed = rows.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    opens = F.col(order) % CHUNK == 0
    mine = F.ln(value) - place * fade
    early = F.ln(F.col(value) * lit(pre)) - (place - 1) * fade  # as it counts for the row before
    summaries = [F.greatest(F.max(mine), F.max(F.when(~opens, early))).alias("_most"), F.max(F.when(opens, F.col(value))).alias("_first"), F.max(F.when(opens, early)).alias("_early")]

    def carry(w) -> list[Column]:
        whole = F.struct(F.greatest("_most", F.lead("_early").over(w)).alias("m"))
        return [whole.alias("_whole"), F.lead("_first").over(w).alias("_next")]

    per = placed.groupBy(key, "_chunk").agg(*summaries)
    by = Window.partitionBy(key).orderBy("_chunk")
    per = per.select(key, "_chunk", *carry(by))
    per = per.select(key, "_chunk", "_next", F.max("_whole.m").over(by.rowsBetween(*_BEFORE)).alias("_carry"))
    inside = Window.partitionBy(key, "_chunk").orderBy(order)
    of = _met(placed, per, [key, "_chunk"])
    fresh = F.greatest(F.col(value), F.coalesce(F.lead(value).over(inside) * lit(pre), F.col("_next") * lit(pre), F.col(value)))
    of = of.withColumn("_fresh", F.ln(fresh) - place * fade)
    lasting = F.greatest(F.max("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carry"))
    return of.withColumn(name, F.exp(lasting + place * fade)).drop("_chunk", "_fresh", "_next", "_carry")


def running_total(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with name: the sum of value over a key's rows before, a long. order numbers its rows 0, 1, 2 ...; null counts as 0."""
    placed = rows.withColumn("_chunk", F.floor(F.col(order) / CHUNK)).withColumn("_value", F.coalesce(value.cast("long"), F.lit(0)))
    carry = lambda w: [F.coalesce(F.sum("_sum").over(w.rowsBetween(*_BEFORE)), F.lit(0)).alias("_carry")]
    of = _carried(placed, [key], [F.sum("_value").alias("_sum")], carry)
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(*_BEFORE)
    return of.withColumn(name, F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.col("_carry")).drop("_chunk", "_value", "_carry")


def last_known(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """rows with name: the last value up to a row that isn't null, or before the first one of its key, that. order numbers a key's rows 0, 1, 2 ..."""
    placed = rows.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    known = F.when(F.col(value).isNotNull(), F.col(order))
    summaries = [F.max_by(value, known).alias("_end"), F.min_by(value, known).alias("_begin")]

    def carry(w) -> list[Column]:
        return [F.last("_end", ignorenulls=True).over(w.rowsBetween(*_BEFORE)).alias("_carry"), F.first("_begin", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_next")]

    of = _carried(placed, [key], summaries, carry)
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return of.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry", "_next")).drop("_chunk", "_carry", "_next")


def sliding_maximum(rows: DataFrame, key: str, order: str, value: Column, radius: int, name: str) -> DataFrame:
    """rows with name: the largest value within radius places on both sides. order numbers a key's rows 0, 1, 2 ...

    Places are cut into stretches as long as the reach, 2 radius + 1. A reach then lies in two stretches at most: it is the end of one and the beginning of
    the next. So each row gives its stretch's maximum up to it to the place whose reach ends there, and from it on to the one whose reach begins
    there: two values a row, whatever the radius. A key's last row ends all reaches that go beyond it.
    """
    reach = 2 * radius + 1
    last = rows.groupBy(key).agg(F.max(order).alias("_last"))
    placed = rows.select(key, F.col(order).alias("_k"), value.alias("_v")).withColumn("_chunk", F.floor(F.col("_k") / reach))
    inside = Window.partitionBy(key, "_chunk").orderBy("_k")
    both = _met(placed, last, [key]).select(key, "_k", "_last", "_chunk", F.max("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_up"), F.max("_v").over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("_down"))
    k, ends = F.col("_k"), (F.col("_chunk") + 1) * reach - 1 - radius
    above = F.array(F.struct((k + radius).alias("t"), F.col("_down").alias("v")))
    below = F.transform(F.when(k == F.col("_last"), F.sequence(k - radius, F.greatest(ends, k - radius))).otherwise(F.array(k - radius)), lambda t: F.struct(t.alias("t"), F.col("_up").alias("v")))
    given = both.select(key, F.explode(F.concat(below, above)).alias("g")).groupBy(key, F.col("g.t").alias(order)).agg(F.max("g.v").alias(name))
    return _met(rows, given, [key, order])


def running_steps(rows: DataFrame, key: str, order: str, value: str, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """rows with name: the running sum of step(value before, value), a long; a key's first row adds nothing. order numbers its rows 0, 1, 2 ..."""
    placed = rows.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    inside = Window.partitionBy(key, "_chunk").orderBy(order)
    stepped = placed.withColumn("_step", step(F.lag(value).over(inside), F.col(value)).cast("long"))
    per = stepped.groupBy(key, "_chunk").agg(F.coalesce(F.sum("_step"), F.lit(0)).alias("_sum"), F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    by = Window.partitionBy(key).orderBy("_chunk")
    per = per.withColumn("_over", F.coalesce(step(F.lag("_last").over(by), F.col("_first")).cast("long"), F.lit(0)))
    carry = F.sum("_over").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_sum").over(by.rowsBetween(*_BEFORE)), F.lit(0))
    of = _met(stepped, per.select(key, "_chunk", carry.alias("_carry")), [key, "_chunk"])
    return of.withColumn(name, (F.coalesce(F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.col("_carry"))).drop("_chunk", "_step", "_carry")


def composed(maps: Column, states: int) -> Column:
    """Maps from entry to (exit, n), an array of them in order, as one map: exits one after the other, the n added up."""
    one = lambda e: F.aggregate(maps, F.struct(e.cast("int").alias("exit"), F.lit(0).cast("long").alias("n")), lambda s, m: let(F.get(m, s.exit), lambda x: F.struct(x.exit.alias("exit"), (s.n + x.n).alias("n"))))
    return F.transform(F.sequence(F.lit(0), F.lit(states - 1)), one)


def entries(maps: Column, entry: Column, n: Column) -> Column:
    """The entry, and the n before it, of each of an array of maps when the first is entered at entry with n before."""
    start = F.array(F.struct(entry.cast("int").alias("exit"), n.cast("long").alias("n")))

    def step(out: Column, m: Column) -> Column:
        now = F.element_at(out, -1)
        return F.concat(out, F.array(let(F.get(m, now.exit), lambda x: F.struct(x.exit.alias("exit"), (now.n + x.n).alias("n")))))

    return F.aggregate(maps, start, step)


def entered(maps: DataFrame, key: str, states: int, first: int, fan: int = 512) -> DataFrame:
    """maps (key, part, map) with entry and before: the state in which each part is entered, and the n of all parts before it.

    Parts are numbered 0, 1, 2 ... in a key and part 0 is entered at `first`. Maps are composed by `fan` parts, these are walked along the key,
    and each `fan` parts are walked from where they are entered; no list is longer than fan, or than parts / fan.
    """
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("part", c))), lambda s: s[c])
    group = F.floor(F.col("part") / fan).alias("_group")
    grouped = maps.groupBy(key, group).agg(in_order("map").alias("_maps"))
    tops = grouped.select(key, F.col("_group").alias("part"), composed(F.col("_maps"), states).alias("map")).groupBy(key).agg(in_order("map").alias("_maps"))
    tops = tops.select(key, F.posexplode(F.slice(entries(F.col("_maps"), F.lit(first), F.lit(0)), F.lit(1), F.size("_maps"))).alias("_group", "_in"))
    walked = grouped.join(tops, [key, "_group"]).select(key, "_group", F.posexplode(F.slice(entries(F.col("_maps"), F.col("_in.exit"), F.col("_in.n")), F.lit(1), F.size("_maps"))).alias("_k", "_at"))
    walked = walked.select(key, (F.col("_group") * fan + F.col("_k")).alias("part"), F.col("_at.exit").alias("entry"), F.col("_at.n").alias("before"))
    return maps.join(walked, [key, "part"])
