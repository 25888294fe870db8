"""Queries over embeddings as frames and spectra, and over line items as channel pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.functions.signal import couple, lit, product_levels, uncouple
from lapwing.operators import masking, quantise, relational, transform
from lapwing.sources.tables import bins, frames, table

QUERIES: dict = {}
ORACLE: dict = {}
RATE, HALF = 44100.0, 64
_B = "b as (select vec_id as frame, label, unnest(range(len(embedding)))::int as k, unnest(embedding)::double as x from embeddings)"
_BARK = "13.1e0 * atan(7.4e-4 * ({0})) + 2.24e0 * atan(1.85e-8 * ({0}) * ({0})) + 1e-4 * ({0})"
_HZ = "(k + 0.5e0) * 344.53125e0"
_PLACED = f"{_B}, z as (select *, {_HZ} as hz, greatest({_BARK.format(_HZ)}, 0) as z from b), p as (select *, floor(z)::int as band from z)"
_BANDS = f"""{_PLACED}, g as (select frame, band, sum(greatest(x * x, 1e-30)) as energy, avg(ln(greatest(x * x, 1e-30))) as log_mean, count(*) as n, (min(z) + max(z)) / 2 as centre from p group by frame, band),
m as (select *, case when energy <= 1e-30 * n then 0 else least(greatest(10 * log10(exp(log_mean) / (energy / n)) / -60, 0), 1) end as tonality, 96 + 10 * log10(energy) as level_db from g),
k as (select *, level_db - (tonality * (14.5e0 + centre) + (1 - tonality) * 5.5e0) as masker_db from m)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(table(spark, sf_dir, "embeddings"))


@query(f"""
with {_B} select frame, c.k::int as k, round(sum(x * cos(pi() / 128 * (2 * b.k + 1 + 32) * (2 * c.k + 1))), 6) + 0 as y from b, range(32) c(k) group by frame, c.k""")
def mdct_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lapped transform of each frame: 64 values to 32."""
    of = _frames(spark, sf_dir).select("frame", F.posexplode(transform.mdct(F.col("x"), 64)).alias("k", "y"))
    return of.select("frame", "k", (F.round("y", 6) + lit(0)).alias("y"))


@query(f"""
with {_B} select a.frame, a.k, round((case when a.k < 32 then a.x - r.x else a.x + r.x end) / 2, 6) + 0 as y from b a join b r on a.frame = r.frame and r.k = case when a.k < 32 then 31 - a.k else 95 - a.k end""")
def mdct_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back gives each half with its mirror image: what overlap-add cancels."""
    x = transform.imdct(transform.mdct(F.col("x"), 64, 1 / 32), 64)
    of = _frames(spark, sf_dir).select("frame", F.posexplode(x).alias("k", "y"))
    return of.select("frame", "k", (F.round("y", 6) + lit(0)).alias("y"))


@query(f"with {_BANDS} select frame, band, n, round(energy, 6) as energy, round(tonality, 6) + 0 as tonality, round(masker_db, 5) as masker_db from k")
def bark_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = masking.bands(bins(_frames(spark, sf_dir)), HALF, RATE)
    return of.select("frame", "band", "n", *[F.round(c, d).alias(c) for c, d in (("energy", 6), ("tonality", 6), ("masker_db", 5))])


_THRESHOLD = f"""{_BANDS}, s as (select p.frame, p.k, p.hz, max(masker_db + case when z >= centre then -10 * (z - centre) else 27 * (z - centre) end) as masked from p join k on p.frame = k.frame group by p.frame, p.k, p.hz),
q as (select *, greatest(hz, 20) / 1000 as f from s),
t as (select frame, k, greatest(pow(10.0e0, (greatest(masked, least(greatest(3.64e0 * pow(f, -0.8e0) - 6.5e0 * exp(-0.6e0 * (f - 3.3e0) * (f - 3.3e0)) + 1e-3 * pow(f, 4), -30), 120)) - 96) / 20), 1.1754943508222875e-38) as threshold from q)"""


@query(f"with {_THRESHOLD} select frame, k, round(threshold, 7) as threshold from t")
def masking_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below what each bin is masked: frames' maskers spread over all their bins."""
    of = masking.thresholds(bins(_frames(spark, sf_dir)), HALF, RATE)
    return of.select("frame", "k", F.round("threshold", 7).alias("threshold"))


@query(f"""
with {_THRESHOLD} select t.frame, (t.k // 16)::bigint as part, round(avg(least(pow(0.25e0 / threshold, 2), 1e4)), 4) as weight from t group by t.frame, t.k // 16""")
def nmr_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much noise at a flat floor would be heard, by partition of 16 bins."""
    long = bins(_frames(spark, sf_dir))
    of = masking.partition_weights(long.select("frame", "k", lit(0.25).alias("floor")), masking.thresholds(long, HALF, RATE), 16)
    return of.select("frame", "part", F.round("weight", 4).alias("weight"))


@query(f"""
with {_B}, g as (select frame, label, x, k, least(floor(({_BARK.format("k * 344.53125e0")}) * 24 / ({_BARK.format("22050.0e0")})), 23)::int as bucket, min(ln(abs(x) + 1e-6)) over (partition by frame) as low from b)
select frame, bucket, count(*) as n, round(avg(pow(ln(abs(x) + 1e-6) - low + 1e-3, 2)), 6) as power from g group by frame, bucket""")
def bark_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the squared, shifted logarithm by bucket of the Bark axis."""
    from lapwing.functions.signal import bark

    level = F.ln(F.abs("x") + lit(1e-6))
    rows = bins(_frames(spark, sf_dir)).withColumn("g", level - F.min(level).over(Window.partitionBy("frame")) + lit(1e-3))
    bucket = F.least(F.floor(bark(F.col("k") * lit(344.53125)) * lit(24) / bark(lit(22050))), F.lit(23)).cast("int")
    return rows.groupBy("frame", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("g") * F.col("g")), 6).alias("power"))


@query(f"""
with {_B}, a as (select frame, x * x as p, (k + 0.5e0) * pi() / 64 as angle, k from b),
w as (select frame, p, angle, case when k = 63 then pi() else (angle + lead(angle) over (partition by frame order by k)) / 2 end - case when k = 0 then 0 else (angle + lag(angle) over (partition by frame order by k)) / 2 end as width from a)
select frame, lag::int as lag, round(sum(p * cos(lag * angle) * width) / pi(), 6) + 0 as r from w, range(9) l(lag) group by frame, lag""")
def lsp_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation of the power spectrum at nine lags, each bin as wide as halfway to its neighbours."""
    by = Window.partitionBy("frame").orderBy("k")
    rows = bins(_frames(spark, sf_dir)).withColumn("angle", (F.col("k") + lit(0.5)) * lit(math.pi / 64))
    high = F.coalesce((F.col("angle") + F.lead("angle").over(by)) / 2, lit(math.pi))
    low = F.coalesce((F.col("angle") + F.lag("angle").over(by)) / 2, lit(0))
    rows = rows.withColumn("width", high - low).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(8))))
    r = F.sum(F.col("x") * F.col("x") * F.cos(F.col("lag") * F.col("angle")) * F.col("width")) / lit(math.pi)
    return rows.groupBy("frame", "lag").agg((F.round(r, 6) + lit(0)).alias("r"))


@query("select vec_id as frame, (i // 2)::int as k, (i % 2)::int as channel, x from (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from embeddings)")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame as two interleaved channels."""
    return bins(_frames(spark, sf_dir)).select("frame", F.floor(F.col("k") / 2).cast("int").alias("k"), (F.col("k") % 2).cast("int").alias("channel"), "x")


#: A codebook of 16 four-dimensional entries, from a rule.
BOOK = [[round(0.3 * math.sin(1.7 * e + 2.3 * d), 3) for d in range(4)] for e in range(16)]
FINE = [[round(0.08 * math.cos(2.1 * e + 1.3 * d), 3) for d in range(4)] for e in range(8)]


def _book_sql(name: str, book: list[list[float]]) -> str:
    rows = ", ".join(f"({e}, [{', '.join(f'{x}e0' for x in row)}]::double[])" for e, row in enumerate(book))
    return f"{name}(entry, y) as (values {rows})"


def _distance_sql(a: str, b: str) -> str:
    return " + ".join(f"({a}[{d}] - {b}[{d}]) * ({a}[{d}] - {b}[{d}])" for d in range(1, 5))


_V = "v as (select vec_id as frame, p::int as part, list_transform(embedding[p * 4 + 1:p * 4 + 4], lambda u: u::double) as x from embeddings, range(16) r(p))"


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, part, x): frames in partitions of four."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.slice(F.col("x"), p * 4 + 1, 4))
    return _frames(spark, sf_dir).select("frame", F.posexplode(parts).alias("part", "x"))


@query(f"""
with {_V}, {_book_sql("c", BOOK)}, d as (select frame, part, entry, round({_distance_sql("x", "y")}, 9) as d2 from v, c)
select frame, part, arg_min(entry, (d2, entry))::int as entry, round(min(d2), 6) as d2 from d group by frame, part""")
def vq_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest codebook entry of each partition, the lowest of equals."""
    return quantise.nearest_entry(_quads(spark, sf_dir), BOOK).select("frame", "part", "entry", F.round("d2", 6).alias("d2"))


@query(f"""
with {_V} select frame, part, sum(greatest(least(ceil((x[d] + 0.4e0) / 0.1e0 - 0.5e0), 8), 0)::bigint * pow(9, d - 1)::bigint)::bigint as entry from v, range(1, 5) r(d) group by frame, part""")
def vq_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of a product grid of nine levels a dimension, as one number."""
    levels = product_levels(6561, 4)
    return _quads(spark, sf_dir).select("frame", "part", quantise.lattice_entry(F.col("x"), -0.4, 0.1, levels).alias("entry"))


@query(f"""
with {_V}, {_book_sql("c", BOOK)}, {_book_sql("f", FINE)},
a as (select frame, part, x, arg_min(entry, (round({_distance_sql("x", "y")}, 9), entry)) as e1 from v, c group by frame, part, x),
l as (select frame, part, e1, [x[1] - y[1], x[2] - y[2], x[3] - y[3], x[4] - y[4]] as x from a join c on c.entry = a.e1),
s as (select frame, part, e1, x, arg_min(entry, (round({_distance_sql("x", "y")}, 9), entry)) as e2 from l, f group by frame, part, e1, x)
select frame, part, e1::int as coarse, e2::int as fine, round({_distance_sql("x", "y")}, 6) as error from s join f on f.entry = s.e2""")
def cascade_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse entry, and a fine one for what it leaves."""
    of = quantise.cascade(_quads(spark, sf_dir), [BOOK, FINE])
    return of.select("frame", "part", F.get("entries", 0).alias("coarse"), F.get("entries", 1).alias("fine"), F.round("error", 6).alias("error"))


@query(f"""
with {_V}, {_book_sql("c", BOOK)}, a as (select frame, part, x, arg_min(entry, (round({_distance_sql("x", "y")}, 9), entry)) as entry from v, c group by frame, part, x)
select entry::int as entry, (d - 1)::int as d, count(*) as n, round(round(avg(x[d]) * 1024) / 1024, 9) + 0 as centre from a, range(1, 5) r(d) group by entry, d""")
def centroid_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training step of a codebook: each entry's mean, on the grid that a book can hold."""
    of = quantise.centroids(quantise.nearest_entry(_quads(spark, sf_dir), BOOK))
    return of.select("entry", "d", "n", F.round("centre", 9).alias("centre"))


@query("""
with n as (select count(*) as n from embeddings), r as (select vec_id, row_number() over (order by vec_id) - 1 as pos from embeddings)
select vec_id from r, n where pos % greatest(1, ceil(n / 64)::bigint) = 0""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 64 vectors, evenly spaced in order of id."""
    return relational.stride_sample(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 64)


_PAIR = "p as (select l_orderkey, l_suppkey, l_quantity - 25 as l, l_extendedprice / 2000 - 25 as r from lineitem)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_quantity") - lit(25)).alias("l"), (F.col("l_extendedprice") / lit(2000) - lit(25)).alias("r"))


@query(f"""
with {_PAIR} select l_suppkey, count(*) as n, round(sum(case when (l > 0) = (l > r) then l else r end), 4) as magnitude, round(sum(case when l > 0 then l - r else r - l end), 4) as angle from p group by l_suppkey""")
def couple_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels as magnitude and angle, summed by supplier."""
    of = _pairs(spark, sf_dir).select("l_suppkey", couple(F.col("l"), F.col("r")).alias("c"))
    return of.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("c.magnitude"), 4).alias("magnitude"), F.round(F.sum("c.angle"), 4).alias("angle"))


@query(f"with {_PAIR} select l_suppkey, count(*) as n, round(sum(l), 4) as left_sum, round(sum(r), 4) as right_sum, 0::bigint as off from p group by l_suppkey")
def couple_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupled and uncoupled: the channels again, none off."""
    of = _pairs(spark, sf_dir).select("l_suppkey", "l", "r", couple(F.col("l"), F.col("r")).alias("c")).select("l_suppkey", "l", "r", uncouple(F.col("c.magnitude"), F.col("c.angle")).alias("u"))
    off = F.count_if((F.abs(F.col("u.left") - F.col("l")) > 1e-9) | (F.abs(F.col("u.right") - F.col("r")) > 1e-9))
    return of.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("u.left"), 4).alias("left_sum"), F.round(F.sum("u.right"), 4).alias("right_sum"), off.alias("off"))


@query(f"""
with {_PAIR}, e as (select l_suppkey, sum(pow(case when (l > 0) = (l > r) then l else r end, 2)) as m, sum(pow(l - r, 2)) as a from p group by l_suppkey)
select l_suppkey, round(a / m, 6) as ratio from e where a / m <= 2e0""")
def coupling_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers' channel pairs are worth coupling."""
    c = couple(F.col("l"), F.col("r"))
    of = relational.coupling_energy(_pairs(spark, sf_dir).select("l_suppkey", c.alias("c")), ["l_suppkey"], F.col("c.magnitude"), F.col("c.angle"))
    return of.where("ratio <= 2").select("l_suppkey", F.round("ratio", 6).alias("ratio"))


#: Classes of a chooser: step of the quantiser, bits, stages.
CLASSES = ((16.0, 1, 1), (4.0, 3, 1), (4.0, 3, 2), (1.0, 6, 2))
_CLASS_SQL = ", ".join(f"({k}, {s}e0, {b}, {n})" for k, (s, b, n) in enumerate(CLASSES))
_COSTS = f"""c(class, step, bits, stages) as (values {_CLASS_SQL}),
k as (select l_orderkey, class, stages, round(sum(pow(l_quantity - round(l_quantity / step) * step, 2)) + 2.0e0 * sum(bits), 6) as cost from lineitem, c group by l_orderkey, class, stages)"""


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, class, stages, cost): error and rate of coding an order's quantities in each class."""
    q = F.col("l_quantity")
    each = F.array(*[F.struct(F.lit(k).alias("class"), F.lit(n).alias("stages"), (F.pow(q - F.round(q / lit(s)) * lit(s), 2) + lit(2 * b)).alias("cost")) for k, (s, b, n) in enumerate(CLASSES)])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(each).alias("c")).select("l_orderkey", "c.*")
    return rows.groupBy("l_orderkey", "class", "stages").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query(f"with {_COSTS} select l_orderkey, arg_min(class, (cost, stages, class))::int as class, min(cost) as cost from k group by l_orderkey")
def class_choice_rd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of least error and rate for each order; fewer stages, then the lower class, of equals."""
    return relational.cheapest(_costs(spark, sf_dir), ["l_orderkey"], F.col("cost"), F.col("stages"), F.col("class")).select("l_orderkey", "class", "cost")


@query(f"with {_COSTS} select class::int as class, round(sum(cost), 3) as cost from k group by class order by round(sum(cost), 3), class limit 1")
def config_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one class that codes everything at least cost."""
    return _costs(spark, sf_dir).groupBy("class").agg(F.round(F.sum("cost"), 3).alias("cost")).orderBy("cost", "class").limit(1)


@query("with r as (select l_suppkey, l_extendedprice as v, row_number() over (partition by l_suppkey order by l_extendedprice) as pos, count(*) over (partition by l_suppkey) as n from lineitem) select l_suppkey, v as median from r where pos = n // 2 + 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.upper_median(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")


@query("""
select r_name, n_name, o_orderpriority, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name, o_orderpriority""")
def star_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts through a chain of dimensions, the small ones first so that the large join carries two columns."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
    orders = t("orders").join(places, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "n_name", "r_name")
    of = t("lineitem").select("l_orderkey", "l_extendedprice").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return of.groupBy("r_name", "n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
select 'dangling' as kind, count(*) as n from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size > 5)
union all select 'resolved', count(*) from lineitem where exists (select 1 from part where p_partkey = l_partkey and p_size > 5)""")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that point to nothing, and those that don't: an anti and a semi join."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    known = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("k"))
    count = lambda how, name: lines.join(known, "k", how).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count("left_anti", "dangling").unionByName(count("left_semi", "resolved"))
