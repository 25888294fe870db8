"""Queries over rate and distortion: choices by codeword lengths, refinement of these, joint training of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.signal import lit
from lapwing.operators import rd_training
from lapwing.plans.vector_queries import _V, BOOK, FINE, _book_sql, _distance_sql, _quads

QUERIES: dict = {}
ORACLE: dict = {}
PRICE = 0.004
START = rd_training.flat_books({"coarse": BOOK, "fine": FINE}, [[], ["coarse"], ["fine"], ["coarse", "fine"]])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SQUARE = "x[1] * x[1] + x[2] * x[2] + x[3] * x[3] + x[4] * x[4]"
_REST = "[x[1] - y[1], x[2] - y[2], x[3] - y[3], x[4] - y[4]]"


@query(f"""
with {_V}, {_book_sql("c", BOOK)}, {_book_sql("f", FINE)},
a as (select frame, part, x, arg_min(entry, (round({_distance_sql("x", "y")}, 9), entry)) as e from v, c group by frame, part, x),
l as (select frame, part, e, x as whole, {_REST} as x from a join c on c.entry = a.e),
s as (select frame, part, e, whole, x, arg_min(entry, (round({_distance_sql("x", "y")}, 9), entry)) as f2 from l, f group by frame, part, e, whole, x),
o as (select frame, part, whole as x, arg_min(entry, (round({_distance_sql("whole", "y")}, 9), entry)) as f1 from l, f group by frame, part, whole),
w as (select frame, part, 0 as class, 0 as n, 0 as bits, {_SQUARE} as error from v
  union all select frame, part, 1, 1, 4, {_SQUARE} from l
  union all select frame, part, 2, 1, 3, {_SQUARE} from (select frame, part, {_REST} as x from o join f on f.entry = o.f1)
  union all select frame, part, 3, 2, 7, {_SQUARE} from (select frame, part, {_REST} as x from s join f on f.entry = s.f2))
select frame, part, arg_min(class, (cost, n, class))::int as class, arg_min(bits, (cost, n, class))::int as bits, round(min(cost), 6) as cost
from (select *, round((1 + part % 3) * error + {PRICE}e0 * bits + case when class = 3 then 0.002e0 else 0 end, 9) as cost from w) group by frame, part""")
def rd_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of least weighted error, bits of its codewords and bias for each partition, by cascades of none, one or two books."""
    rows = _quads(spark, sf_dir).withColumn("w", lit(1) + F.col("part") % 3)
    of = rd_training.planned(rows, START, PRICE, weight="w", bias=(0.0, 0.0, 0.0, 0.002))
    return of.select("frame", "part", "class", "bits", F.round("cost", 6).alias("cost"))


@query()
def rd_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition's class and bits once codewords and plan fit each other. Lengths come from an iteration; a test holds the bits against the emitted symbols' cost."""
    rows = _quads(spark, sf_dir)
    books, _ = rd_training.refined(rows, ["frame", "part"], START, PRICE)
    of = rd_training.planned(rows, books, PRICE)
    return of.select("frame", "part", "class", "bits", F.transform("stages", lambda s: s.entry).alias("entries"), F.round("error", 6).alias("error"))


@query()
def rd_training_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and bits before each round of joint training, and the last cost. A test replays the rounds in plain Python."""
    done = rd_training.train(_quads(spark, sf_dir), ["frame", "part"], START, PRICE, 3)
    return spark.createDataFrame([(k, c, b) for k, (c, b) in enumerate(zip(done.costs, done.bits))], "round int, cost double, bits long")
