"""Queries over layouts: posts, resampling, factoring, coupling steps, residue windows, packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.signal import lit
from lapwing.operators import layout, quantise
from lapwing.plans.vector_queries import _B, _frames, _quads
from lapwing.sources.tables import bins, samples, table

QUERIES: dict = {}
ORACLE: dict = {}
POSTS = [9, 17, 33]
STEPS = [(0, 1), (1, 2), (3, 0)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_PLACE = "least(case when abs(x) >= 1 then 255 when exp((1 - (pos + 1) / 255.0e0) * ln(1.0649863e-07)) - abs(x) < abs(x) - exp((1 - pos / 255.0e0) * ln(1.0649863e-07)) then pos + 1 else pos end, 255)::int"
_LADDER = f"l as (select frame, k, {_PLACE} as y from (select *, greatest(0, least(floor((1 - ln(greatest(abs(x), 1.0649863e-07)) / ln(1.0649863e-07)) * 255.0e0), 254)) as pos from b))"


@query(f"""
with {_B}, {_LADDER}, p(x0, x1) as (values (0, 9), (9, 17), (17, 33), (33, 64)),
s as (select l.frame, l.k, l.y, a.y as y0, z.y as y1, x0, x1 from l join p on l.k >= x0 and l.k < x1 join l a on a.frame = l.frame and a.k = x0 join l z on z.frame = l.frame and z.k = least(x1, 63))
select frame, round(sum(pow(y - (y0 + (y1 - y0) * (k - x0) / (x1 - x0)::double), 2)), 5) as error from s group by frame""")
def post_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    magnitude = F.transform("x", lambda v: F.abs(v))
    return _frames(spark, sf_dir).select("frame", F.round(layout.post_distortion(magnitude, 64, POSTS), 5).alias("error"))


@query(f"""
with {_B}, i as (select frame, g::int as k, g * (63.0e0 / 47) as pos from (select distinct frame from b), range(48) r(g))
select i.frame, i.k, round(a.x * (1 - (pos - floor(pos))) + z.x * (pos - floor(pos)), 6) + 0 as y from i join b a on a.frame = i.frame and a.k = floor(pos) join b z on z.frame = i.frame and z.k = least(floor(pos) + 1, 63)""")
def resample_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 64 at 48 places."""
    of = _frames(spark, sf_dir).select("frame", F.posexplode(layout.resampled(F.col("x"), 64, 48)).alias("k", "y"))
    return of.select("frame", "k", (F.round("y", 6) + lit(0)).alias("y"))


@query(f"""
with {_B} select frame, round(sum(case when frame % 7 = 0 then 0 else x / (0.1e0 + k / 64.0e0) end), 5) + 0 as residue, round(sum(case when frame % 7 = 0 then 0 else x end), 5) + 0 as spectrum from b group by frame""")
def spectrum_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra over their floors, and back; every seventh frame has no floor."""
    floor = F.when(F.col("frame") % 7 != 0, F.transform("x", lambda v, k: lit(0.1) + k / lit(64)))
    of = _frames(spark, sf_dir).withColumn("floor", floor).withColumn("residue", layout.factored(F.col("x"), F.col("floor")))
    total = lambda c: F.round(F.aggregate(c, lit(0), lambda s, v: s + v), 5) + lit(0)
    return of.select("frame", total(F.col("residue")).alias("residue"), total(layout.unfactored(F.col("residue"), F.col("floor"), 64)).alias("spectrum"))


@query("""
with u as (select event_id, (event_id & 1) > 0 as a, (event_id & 2) > 0 as b, (event_id & 4) > 0 as c, (event_id & 8) > 0 as d from events)
select event_id, (case when d or a or b then 1 else 0 end) + (case when a or b or c then 2 else 0 end) + (case when a or b or c then 4 else 0 end) + (case when d or a or b then 8 else 0 end) as used from u""")
def nonzero_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four channels are used after three coupling steps, as bits."""
    flags = F.array(*[F.col("event_id").bitwiseAND(F.lit(1 << k)) > 0 for k in range(4)])
    used = layout.spread_use(flags, STEPS)
    bits = F.aggregate(F.transform(used, lambda u, k: F.when(u, F.pow(lit(2), k).cast("int")).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return table(spark, sf_dir, "events").select("event_id", bits.alias("used"))


@query()
def coupling_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as four channels of 16: which coupling steps pay. Later steps see what earlier ones changed; a test walks them in plain Python."""
    channels = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice(F.col("x"), c * 16 + 1, 16))
    return _frames(spark, sf_dir).select("frame", layout.pruned_steps(channels, STEPS, 1.2).alias("kept"))


@query("""
with h as (select o_orderkey, (32 * pow(2, o_custkey % 8))::bigint as half, [8000, 22050, 44100, 48000, 96000][(o_orderkey % 5 + 1)::int]::bigint as rate from orders),
s as (select *, case when half >= 512 then 32 else 16 end as partition from h)
select o_orderkey, half, rate, partition, (case when rate / 2.0e0 <= 20000 then half else least(ceil(ceil(half * 20000.0e0 / (rate / 2.0e0)) / partition) * partition, half) end)::bigint as "end" from s""")
def residue_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.array(*map(F.lit, (8000, 22050, 44100, 48000, 96000)))
    of = table(spark, sf_dir, "orders").select("o_orderkey", (lit(32) * F.pow(lit(2), F.col("o_custkey") % 8)).cast("long").alias("half"), F.get(rates, (F.col("o_orderkey") % 5).cast("int")).cast("long").alias("rate"))
    return of.select("*", layout.residue_window(F.col("half"), F.col("rate")).alias("w")).select("o_orderkey", "half", "rate", "w.*")


@query(f"""
with {_B}, g as (select frame, f % 2 as format, p, r, j, case when f % 2 = 0 then r + j * 4 else r * 4 + j end as place from (select distinct frame from b), range(2) a(f), range(4) c(p), range(4) d(r), range(4) e(j))
select g.frame, format::int as format, p::int as part, r::int as read, round(sum(x * (j + 1)), 6) + 0 as total from g join b on b.frame = g.frame and b.k = p * 16 + place group by g.frame, format, p, r""")
def residue_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that four reads of a partition take, strided and in a row, told by weighted sums."""
    one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = _frames(spark, sf_dir).select("frame", "x", one(2).alias("format")).select("*", one(4).alias("part")).select("*", one(4).alias("read"))
    places = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get(F.col("x"), F.col("part") * 16 + layout.gather_place(F.col("format") == 0, F.col("read"), j, 4, 4)) * (j + 1))
    return of.select("frame", "format", "part", "read", (F.round(F.aggregate(places, lit(0), lambda s, v: s + v), 6) + lit(0)).alias("total"))


@query("""
with s as (select user_id, event_id, ts, value, event_type = 'purchase' as ends from events),
p as (select *, coalesce(sum(ends::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as packet from s)
select user_id, packet, count(*) as segments, bool_or(ends) as complete, round(sum(value), 4) as total from p group by user_id, packet""")
def packet_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as segments of packets that purchases end."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (F.col("event_type") == "purchase").alias("ends"))
    of = layout.assembled(e, "user_id", F.col("ends"), "ts", "event_id")
    return of.groupBy("user_id", "packet").agg(F.count("*").alias("segments"), F.bool_or("ends").alias("complete"), F.round(F.sum("value"), 4).alias("total"))


@query("""
with c(class, step) as (values (0, 32.0e0), (1, 8.0e0), (2, 4.0e0), (3, 2.0e0)), k as (select l_orderkey, class, round(avg(pow(l_quantity - round(l_quantity / step) * step, 2)), 6) as error from lineitem, c group by l_orderkey, class)
select l_orderkey, coalesce(min(class) filter (error <= 1.5), arg_min(class, (error, class)))::int as class from k group by l_orderkey""")
def order_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first class that is good enough for each order, or the best."""
    q = F.col("l_quantity")
    each = F.array(*[F.struct(F.lit(k).alias("class"), F.pow(q - F.round(q / lit(s)) * lit(s), 2).alias("e")) for k, s in enumerate((32, 8, 4, 2))])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(each).alias("c")).groupBy("l_orderkey", "c.class").agg(F.round(F.avg("c.e"), 6).alias("error"))
    return layout.first_within(rows, ["l_orderkey"], "class", "error", 1.5)


@query("""
with s as (select user_id as stream, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as i, value as x from events where value is not null),
g as (select stream, max(i) filter (floor(x)::bigint % 5 = 0) as last from s group by stream)
select s.stream, count(*) as n, round(sum(x), 4) as total from s join g on s.stream = g.stream and i < last group by s.stream""")
def end_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples up to each stream's last marked place."""
    rows = samples(table(spark, sf_dir, "events"))
    last = rows.where(F.floor("x") % 5 == 0).groupBy("stream").agg(F.max("i").alias("last"))
    return rows.join(last, "stream").where("i < last").groupBy("stream").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query()
def vq_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook of eight entries trained on quarters of frames, with the error after the last pass."""
    book, errors = quantise.design_codebook(_quads(spark, sf_dir).select("x"), 8, 4)
    return spark.createDataFrame([(k, row, float(errors[-1])) for k, row in enumerate(book)], "entry int, centre array<double>, error double")


@query(f"with {_B} select frame, count(*) as n, round(max(abs(x)), 6) as peak, ceil(log2(count(*)))::int as rangebits from b group by frame")
def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size and peak of each frame, and the bits that its places take."""
    return bins(_frames(spark, sf_dir)).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.max(F.abs("x")), 6).alias("peak"), F.ceil(F.log2(F.count("*"))).cast("int").alias("rangebits"))
