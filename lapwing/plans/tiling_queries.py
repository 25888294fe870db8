"""Queries over tilings and envelope headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators import tiling
from lapwing.operators.layout import plan_posts
from lapwing.plans.layout_queries import _LADDER
from lapwing.plans.vector_queries import _B, _frames
from lapwing.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}
#: Catalogues of class sizes, some of which leave gaps or are not legal.
CATALOGUES = [[1, 2, 3, 4], [3, 2], [8, 5], [7, 1], [4, 6, 2], [5], [2, 2, 8], [9, 1]]
MOST_POSTS, TOLERANCE = 7, 12.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _tiling_sql(most: int) -> str:
    """Common tables t (catalogue k: least counts n and last classes c for 0 to `most` posts) and w (its classes for each number of posts)."""
    rows = ", ".join(f"({k}, {d})" for k, d in enumerate(CATALOGUES))
    best = "list_min(list_filter([case when sizes[i] <= r + 1 then {'n': n[r + 2 - sizes[i]] + 1, 'c': i - 1} end for i in range(1, len(sizes) + 1)], lambda x: x.n is not null))"
    return f"""cat(k, sizes) as (values {rows}), ok as (select k, sizes from cat where list_max(sizes) <= 8 and list_min(sizes) >= 1),
t as (select k, sizes, 0 as r, [0] as n, [null::int] as c from ok union all select k, sizes, r + 1, list_append(n, b.n::int), list_append(c, b.c::int) from (select *, {best} as b from t) where r < {most}),
full_t as (select * from t where r = {most}),
w as (select k, sizes, n, c, p::int as posts, p::int as left_over, []::int[] as classes from full_t, range(1, {most + 1}) g(p) where n[p + 1] <= 31
  union all select k, sizes, n, c, posts, left_over - sizes[c[left_over + 1] + 1], list_prepend(c[left_over + 1], classes) from w where left_over > 0),
tiled as (select k, posts, classes from w where left_over = 0)"""


@query(f"""
with recursive {_tiling_sql(65)}, o as (select (o_custkey % 66)::int as posts, (o_orderkey % {len(CATALOGUES)})::int as catalogue, count(*) as orders from orders group by 1, 2)
select o.posts, catalogue, orders, coalesce(len(classes), -1)::int as partitions, array_to_string(classes, ',') as classes from o left join tiled t on t.k = catalogue and t.posts = o.posts""")
def tile_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest partitions for each number of posts and catalogue that orders ask for; -1 and null where none tiles. Asked for once each."""
    asked = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 66).cast("int").alias("posts"), (F.col("o_orderkey") % len(CATALOGUES)).cast("int").alias("catalogue")).agg(F.count("*").alias("orders"))
    sizes = F.get(F.array(*[F.array(*map(F.lit, c)) for c in CATALOGUES]), F.col("catalogue"))
    of = asked.withColumn("c", tiling.tiling(F.col("posts"), sizes))
    return of.select("posts", "catalogue", "orders", F.when(F.col("c").isNotNull(), F.size("c")).otherwise(-1).alias("partitions"), F.array_join("c", ",").alias("classes"))


_BEFORE, _AFTER = "list_max([p for p in posts if p < i])", "list_min([p for p in posts if p > i])"
_OFF = f"abs(y[i + 1] - (y[{_BEFORE} + 1] + (y[least({_AFTER}, 63) + 1] - y[{_BEFORE} + 1])::double * (i - {_BEFORE}) / ({_AFTER} - {_BEFORE})))"


def _posts_sql(most: int, tolerance: float) -> str:
    """Common tables y (each frame's places on the ladder) and posts (frame, inner): one post a round, at the bin furthest from the lines, the first of equals."""
    return f"""y as (select frame, list(y order by k) as y from l group by frame),
g as (select frame, y, 0 as step, [0, 64] as posts from y
  union all select frame, y, step + 1, case when worst.e > {tolerance} then list_sort(list_append(posts, (-worst.i)::int)) else posts end
  from (select *, list_max([{{'e': case when list_contains(posts, i) then -1 else {_OFF} end::double, 'i': -i}} for i in range(1, 64)]) as worst from g) where step < {most}),
posts as (select frame, posts[2:len(posts) - 1] as inner_posts from g where step = {most})"""


def _sizes(k: int):
    return F.array(*map(F.lit, CATALOGUES[k]))


@query(f"""
with recursive {_B}, {_LADDER}, {_posts_sql(5, 0.0)} select frame, (k - 1)::int as k, inner_posts[k]::int as x from posts, range(1, 6) r(k) where k <= len(inner_posts)""")
def post_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five posts for each frame's envelope, each furthest from the lines between those before it."""
    magnitude = F.transform("x", lambda v: F.abs(v))
    return _frames(spark, sf_dir).select("frame", F.posexplode(plan_posts(magnitude, 64, 5)).alias("k", "x"))


@query(f"""
with recursive {_B}, {_LADDER}, {_posts_sql(MOST_POSTS, TOLERANCE)}, {_tiling_sql(MOST_POSTS)},
h as (select p.frame, inner_posts, (p.frame % {len(CATALOGUES)})::int as catalogue, case when len(inner_posts) = 0 then []::int[] else classes end as classes from posts p left join tiled t on t.k = p.frame % {len(CATALOGUES)} and t.posts = len(inner_posts))
select frame, catalogue, case when classes is not null then 6 else -1 end as range_bits, case when classes is not null then array_to_string(inner_posts, ',') end as posts, array_to_string(classes, ',') as classes,
  case when classes is not null then array_to_string([array_to_string(inner_posts[(1 + coalesce(list_sum([cat.sizes[c + 1] for c in classes[1:j - 1]]), 0))::int:list_sum([cat.sizes[c + 1] for c in classes[1:j]])::int], ',') for j in range(1, len(classes) + 1)], ';') end as parts
from h join cat on cat.k = catalogue""")
def header_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header for each frame's envelope: posts by refinement, tiled by the classes of a catalogue, and the bits of its places."""
    frames = _frames(spark, sf_dir).withColumn("catalogue", (F.col("frame") % len(CATALOGUES)).cast("int"))
    sizes = F.get(F.array(*[_sizes(k) for k in range(len(CATALOGUES))]), F.col("catalogue"))
    of = frames.withColumn("h", tiling.envelope_header(F.transform("x", lambda v: F.abs(v)), 64, MOST_POSTS, TOLERANCE, sizes))
    text = lambda a: F.array_join(a, ",")
    return of.select("frame", "catalogue", F.coalesce("h.range_bits", F.lit(-1)).alias("range_bits"), text(F.col("h.posts")).alias("posts"), text(F.col("h.classes")).alias("classes"), F.array_join(F.transform("h.parts", text), ";").alias("parts"))
