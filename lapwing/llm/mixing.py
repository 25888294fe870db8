"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

Each source has a weight schedule over training time, piecewise linear between knots. Its integral,
scaled to the source's target, is the source's cumulative token demand; documents are laid end to end
along that demand in a fixed pseudo-random order, and inverting it gives each copy's training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.common import saved, spare, table, text_of, words_of

#: Base weights, by the source's place in code-point order (null last), repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Weight multipliers at evenly spaced knots of training time, by place, repeating: fading, steady, rising.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
SHARE, MAX_REPEATS = 1.5, 2
#: Hash buckets of a source for the two-level running sum; a bucket is one window partition.
BUCKET_DIGITS = 3
#: Sources, a few hundred bytes each, whose targets are broadcast; of more they are joined by shuffle.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, place, source_size, target) from (source, size).

    Targets split share x all sizes by weight; a target stops at max_repeats x its source's size and the
    excess is shared again by weight. Filling in the order of cap / weight gives that fixed point at once.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))  # one row for each source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = (
        per.withColumn("place", F.row_number().over(one) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(Window.partitionBy(F.lit(1))))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.max("level").over(Window.partitionBy(F.lit(1))))  # it rises while caps are below it, then falls
    )
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    return per.select("source", "place", "source_size", target.alias("target"))


def _segments(targets: DataFrame, schedules) -> DataFrame:
    """The integral of each source's schedule by segment: (source, t0, dt, w0, w1, d0, d1), demand normalised to 1."""
    rows = []
    for knots in schedules:
        dt = 1.0 / (len(knots) - 1)
        areas = [(x + y) / 2 * dt for x, y in zip(knots, knots[1:])]
        total, done, out = sum(areas), 0.0, []
        for k, area in enumerate(areas):
            out.append(F.struct(F.lit(k * dt).alias("t0"), F.lit(dt).alias("dt"), F.lit(knots[k] / total).alias("w0"), F.lit(knots[k + 1] / total).alias("w1"), F.lit(done / total).alias("d0"), F.lit(1.0 if k == len(areas) - 1 else (done + area) / total).alias("d1")))
            done += area
        rows.append(F.array(*out))
    pick = F.element_at(F.array(*rows), (F.col("place") % len(schedules) + 1).cast("int"))
    every = Window.partitionBy(F.lit(1))  # one row for each source
    demand = [F.coalesce(F.sum(F.when(F.col("place") % len(schedules) == k, F.col("target"))).over(every), F.lit(0.0)) for k in range(len(schedules))]
    return targets.withColumn("segments", pick).withColumn("demand", F.array(*[F.struct(d.alias("tokens"), r.alias("segments")) for d, r in zip(demand, rows)]))


def plan_mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each document and copy: doc_id, source, hash, occurrence (1, 2, ... for rows with the same
    source and doc_id), size, source_size, target, copy (0 means not taken), position.

    A document's size is its number of words (null text: 0). Within a source, documents follow
    md5(doc_id), ties by doc_id; running sums of size are exact longs, so reruns agree. Every document is
    taken floor(target / source_size) times, and once more while the middle of it lies within the rest; never
    more than max_repeats times. The training time of a copy is that at which its source's demand reaches it, and its
    position is the demand of all sources by then, in words: it differs from the words really before the copy by less than a
    document of each source. Sources with no words have target 0. Repeated rows count as documents of their own, and
    take their place one after the other; null doc_ids come first. An empty table gives no row.
    """
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    sizes = docs.select("doc_id", "source", F.size(words_of(text_of())).cast("long").alias("size"), key.alias("key"), F.xxhash64("text").alias("hash"))
    sizes = saved(sizes.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    targets = saved(_segments(source_targets(sizes, weights, share, max_repeats), schedules))
    by_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("source", "bucket", "doc_id").orderBy("size", "hash")
    laid = sizes.withColumn("occurrence", F.row_number().over(same)).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    laid = laid.join(by_bucket, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("before", F.col("within") + F.col("offset")).drop("s", "b", "within", "offset")
    t = targets.select(F.col("source").alias("s"), "source_size", "target", "segments", "demand")
    t = F.broadcast(t) if targets.count() <= BROADCAST_SOURCES else t
    laid = laid.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    laid = laid.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    more = F.when((F.col("source_size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")), 1).otherwise(0)
    laid = laid.withColumn("copies", F.least(F.col("whole") + more, F.lit(max_repeats)))
    copies = laid.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(0)))))
    x = F.when((F.col("copy") > 0) & (F.col("target") > 0), F.least(((F.col("copy") - 1) * F.col("source_size") + F.col("before")) / F.col("target"), F.lit(1.0)))
    copies = copies.withColumn("x", x).withColumn("seg", F.get(F.expr("filter(segments, s -> s.d0 <= x and (x < s.d1 or s.d1 = 1.0))"), 0))
    # w0 u + (w1 - w0) / (2 dt) u^2 = x - d0, in a form that needs no case for w0 = w1
    need, w0, w1, dt = F.col("x") - F.col("seg.d0"), F.col("seg.w0"), F.col("seg.w1"), F.col("seg.dt")
    slope = (w1 - w0) / dt
    u = F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * need, F.lit(0.0)))))
    copies = copies.withColumn("u", F.col("seg.t0") + u)
    v, t0, dt = F.col("u"), lambda s: s.t0, lambda s: s.dt
    done = lambda s: s.d0 + (s.w0 + (s.w1 - s.w0) / (2 * dt(s)) * (v - t0(s))) * (v - t0(s))
    part = lambda d: d.tokens * done(F.element_at(F.filter(d.segments, lambda s: s.t0 <= v), -1))
    position = F.when(v.isNotNull(), F.aggregate(F.transform("demand", part), F.lit(0.0), lambda a, x: a + x))
    return copies.select("doc_id", "source", "hash", "occurrence", "size", "source_size", "target", "copy", position.alias("position"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents of docs in training order, each as often as the mix takes it; columns as in docs.

    Rows are dealt by range of position and sorted within each part, so that parts follow one another.
    Repeated rows are told apart by their text's hash and their place among equals, so each is joined to its own copies.
    """
    doc_id, source, hash_, n, position, of = (spare(c, docs) for c in ("_mix_id", "_mix_source", "_mix_hash", "_mix_n", "_mix_position", "_mix_of"))
    names = {"doc_id": doc_id, "source": source, "hash": hash_, "occurrence": n, "position": position}
    plan = plan_mix(docs.select("doc_id", "source", "text"), **how).where("copy > 0").select(*[F.col(k).alias(v) for k, v in names.items()])
    plan = saved(plan)
    here = F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.xxhash64("text") == F.col(hash_))
    repeated = plan.groupBy(doc_id, source, hash_).agg(F.countDistinct(n).alias("n")).where("n > 1")
    rows = docs
    if not repeated.isEmpty():  # rows alike in all of these: number them as the plan does
        same = Window.partitionBy("doc_id", "source").orderBy(F.size(words_of(text_of())).cast("long"), F.xxhash64("text"))
        rows, here = docs.select("*", F.row_number().over(same).alias(of)), here & (F.col(of) == F.col(n))
    rows = rows.join(plan, here)
    return rows.repartitionByRange(position, "doc_id").sortWithinPartitions(position, "doc_id").select(*docs.columns)


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    taken = F.sum(F.when(F.col("copy") > 0, F.col("size")).otherwise(0)).cast("long")
    return plan.groupBy("doc_id", "source", "hash", "occurrence", "size", "source_size", "target").agg(taken.alias("taken"), F.round(F.min("position"), 2).alias("first_position")).select("doc_id", "size", "source_size", "target", "taken", "first_position")


OP4_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, coalesce(md5(doc_id::varchar), '') as key
  from documents
), per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source
), weighted as (
  select *, [3.0, 1.0, 2.0][(place % 3 + 1)::int]::double as weight, 2.0::double * source_size as cap from per
), filled as (
  select *, cap / weight as ratio, 1.5::double * sum(source_size) over () as total from weighted
), levels as (
  select *, (total - coalesce(sum(cap) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by ratio, place rows between current row and unbounded following) as level from filled
), targets as (
  select source, place, source_size, least(cap, weight * max(level) over ())::double as target from levels
), laid as (
  select s.*, t.place, t.source_size, t.target,
    coalesce(sum(size) over (partition by s.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before,
    case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole
  from sized s join targets t on s.source is not distinct from t.source
), copied as (
  select *, least(whole + case when source_size > 0 and 2 * before + size <= 2 * (target - whole * source_size) then 1 else 0 end, 2) as copies from laid
), placed as (
  select *, case when copies > 0 and target > 0 then least(before::double / target, 1.0::double) end as x,
    [[1.5, 0.5], [1.0, 1.0], [0.5, 1.5]][(place % 3 + 1)::int] as ends from copied
), segments as (
  select *, case when x < (ends[1] + 1.0) / 4.0 then 0 else 1 end as k,
    case when x < (ends[1] + 1.0) / 4.0 then 0.0 else (ends[1] + 1.0) / 4.0 end::double as d0,
    case when x < (ends[1] + 1.0) / 4.0 then ends[1] else 1.0 end::double as w0,
    case when x < (ends[1] + 1.0) / 4.0 then 1.0 else ends[2] end::double as w1 from placed
), timed as (
  select *, k * 0.5::double + case when x is null then null when x - d0 <= 0 then 0.0::double else 2 * (x - d0) / (w0 + sqrt(greatest(w0 * w0 + 2 * ((w1 - w0) / 0.5::double) * (x - d0), 0.0))) end as u from segments
)
select doc_id, size, source_size, target, (copies * size)::bigint as taken,
  round((select sum(tokens * (d0 + (w0 + (w1 - w0) / (2 * 0.5::double) * (u - t0)) * (u - t0)) order by j) from (
    select j, tokens, case when u < 0.5 then 0.0 else 0.5 end::double as t0, case when u < 0.5 then 0.0 else (e[1] + 1.0) / 4.0 end::double as d0,
      case when u < 0.5 then e[1] else 1.0 end::double as w0, case when u < 0.5 then 1.0 else e[2] end::double as w1
    from (select k.j, coalesce((select sum(target) from targets where place % 3 = k.j), 0.0)::double as tokens, [[1.5, 0.5], [1.0, 1.0], [0.5, 1.5]][(k.j + 1)::int] as e from (values (0), (1), (2)) k(j))
  )), 2) as first_position
from timed
"""
