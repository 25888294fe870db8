"""Queries over closed-loop prediction, predicted posts, the choice of their books, floors of frames, and comment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.signal import let, lit
from lapwing.operators import coding, layout, masking, prediction
from lapwing.plans.layout_queries import _LADDER
from lapwing.plans.vector_queries import _B, _THRESHOLD, _book_sql, _frames
from lapwing.sources import records
from lapwing.sources.tables import bins, table

QUERIES: dict = {}
ORACLE: dict = {}
#: Rising vectors, as frequencies in ascending order need them.
RISES = [[round((d + 1) * (0.002 + 0.009 * e) * (1 + 0.3 * ((e * 7 + d * 3) % 5)), 4) for d in range(4)] for e in range(16)]
#: Posts of frames: both ends, then inner ones in the order of their coding; slots of their books and choices.
XS = [0, 64, 32, 16, 48, 8, 24, 40, 56]
CHOICES = list(range(0, 64, 3))
RADIUS = 7


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _near_sql(last: str) -> str:
    return f"list_min([{{'d2': round(list_sum([pow(c[4 * v + d] - {last} - y[e + 1][d], 2) for d in range(1, 5)]), 9), 'e': e}} for e in range(16)]).e"


@query(f"""
with recursive {_B}, {_book_sql("r", RISES)}, rises as (select list(y order by entry) as y from r), f as (select frame, list_sort(list(x)) as c from b group by frame),
w as (select frame, c, y, 0 as v, 0.0::double as last, 0.0::double as err, 0.0::double as o, 0.0::double as open_err, []::int[] as entries from f, rises
  union all select frame, c, y, v + 1, last + y[e + 1][4], err + list_sum([pow(c[4 * v + d] - last - y[e + 1][d], 2) for d in range(1, 5)]),
    o + y[g + 1][4], open_err + list_sum([pow(c[4 * v + d] - o - y[g + 1][d], 2) for d in range(1, 5)]), list_append(entries, e::int)
  from (select *, {_near_sql("last")} as e, {_near_sql("case when v = 0 then 0 else c[4 * v] end")} as g from w where v < 16))
select frame, array_to_string(entries, ',') as entries, round(err, 6) as closed_error, round(open_err, 6) as open_error from w where v = 16""")
def closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's values in ascending order as entries above the last rebuilt value, and the error; beside it the error of prediction from exact values."""
    of = _frames(spark, sf_dir).select("frame", F.array_sort("x").alias("c"))
    loop = lambda closed: prediction.coded_in_loop(F.col("c"), RISES, 4, closed)
    error = lambda out: F.aggregate(F.zip_with("c", F.flatten(F.transform(out, lambda s: s.rebuilt)), lambda a, b: (a - b) * (a - b)), lit(0), lambda s, e: s + e)
    of = of.select("frame", let(loop(True), lambda out: F.struct(F.array_join(F.transform(out, lambda s: s.entry), ",").alias("entries"), error(out).alias("error"))).alias("closed"), error(loop(False)).alias("open"))
    return of.select("frame", "closed.entries", F.round("closed.error", 6).alias("closed_error"), F.round("open", 6).alias("open_error"))


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, ys): each frame's heights on the ladder at XS; inner posts whose place plus the frame's number is a multiple of 5 are left out."""
    ladder = F.transform(layout.on_ladder(F.transform("x", lambda v: F.abs(v))), lambda v: v.cast("int"))
    ys = lambda y: F.array(*[F.get(y, F.lit(min(x, 63))) if k < 2 else F.when((F.col("frame") + k) % 5 != 0, F.get(y, F.lit(x))) for k, x in enumerate(XS)])
    return _frames(spark, sf_dir).select("frame", let(ladder, ys).alias("ys"))


def _xs() -> Column:
    return F.array(*map(F.lit, XS))


def _posts_sql() -> str:
    """Common tables s0 to s7: the heights of a frame's posts as they come out, and the values of each inner one."""
    out = ["y as (select frame, list(y order by k) as y from l group by frame), s0 as (select frame, y, [y[1], y[64]]::int[] as h, []::int[] as p, []::int[] as v from y)"]
    for k in range(2, len(XS)):
        x, before = XS[k], XS[:k]
        low, high = max(b for b in before if b < x), min(b for b in before if b > x)
        y0, y1 = f"h[{XS.index(low) + 1}]", f"h[{XS.index(high) + 1}]"
        line = f"case when {y1} < {y0} then {y0} - (abs({y1} - {y0}) * {x - low}) // {high - low} else {y0} + (abs({y1} - {y0}) * {x - low}) // {high - low} end"
        value = "case when g is null or g = q then 0 when g > q then case when 2 * (g - q) >= room then case when 256 - q > q then g else 255 - g end else 2 * (g - q) end else case when 2 * (q - g) - 1 >= room then case when 256 - q > q then g else 255 - g end else 2 * (q - g) - 1 end end"
        out.append(f"s{k - 1} as (select frame, y, list_append(h, coalesce(g, q)::int) as h, list_append(p, q::int) as p, list_append(v, ({value})::int) as v from (select *, case when (frame + {k}) % 5 <> 0 then y[{x + 1}] end as g, 2 * least(256 - q, q) as room from (select *, {line} as q from s{k - 2})))")
    return ", ".join(out)


@query(f"""
with {_B}, {_LADDER}, {_posts_sql()}
select frame, {"[" + ", ".join(map(str, XS[2:])) + "]"}[k]::int as x, h[k + 2] as y, p[k] as predicted, v[k] as value, v[k] <> 0 as coded, true as same from s{len(XS) - 2}, range(1, {len(XS) - 1}) r(k)""")
def predicted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of each frame, a fifth of them left out, predicted from what comes out of those before, and whether values alone give the same heights back."""
    of = _given(spark, sf_dir).select("frame", prediction.planned_posts(_xs(), F.col("ys"), 256).alias("posts"))
    heights = lambda posts: F.transform(posts, lambda q: q["y"])
    back = prediction.rebuilt_posts(_xs(), F.transform("posts", lambda q: q["value"]), 256)
    of = of.select("frame", (heights(back) == heights(F.col("posts"))).alias("same"), F.explode(F.slice("posts", F.lit(3), F.size("posts") - 2)).alias("post"))
    return of.select("frame", "post.x", "post.y", "post.predicted", "post.value", "post.coded", "same")


_CHOSEN_SQL = f"""{_B}, {_LADDER}, {_posts_sql()},
t as (select frame, part::int as part, j::int as j, v[part * 2 + j + 1] as y from s{len(XS) - 2}, range(4) a(part), range(2) c(j) where part * 2 + j < {len(XS) - 2}),
held as (select distinct p_partkey % 7 as slot, p_size * 2 + p_partkey % 2 as y from part),
fits as (select t.frame, t.part, t.j, s.slot, case when s.slot = 7 then t.y = 0 else h.y is not null end as ok from t cross join range(8) s(slot) left join held h on h.slot = s.slot and h.y = t.y),
ways as (select frame, part, c, bool_and(ok) as ok from fits, (select unnest({CHOICES}) as c) where slot = (c // pow(8, j)::int) % 8 group by frame, part, c),
chosen as (select frame, part, min(c) filter (ok) as choice from ways group by frame, part)"""


def _chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(frame, part, j, y): the posts' values in partitions of two; and (frame, part, choice)."""
    of = _given(spark, sf_dir).select("frame", prediction.planned_posts(_xs(), F.col("ys"), 256).alias("posts"))
    values = of.select("frame", F.posexplode(F.slice("posts", F.lit(3), F.size("posts") - 2)).alias("k", "post"))
    values = values.select("frame", F.floor(F.col("k") / 2).cast("int").alias("part"), (F.col("k") % 2).alias("j"), F.col("post.value").alias("y"))
    leaves = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).cast("int").alias("slot"), (F.col("p_size") * 2 + F.col("p_partkey") % 2).cast("int").alias("y"))
    return values, prediction.chosen(values, ["frame", "part"], leaves, CHOICES, 3, 7)


@query(f"with {_CHOSEN_SQL} select frame, part, coalesce(choice, -1)::int as choice from chosen")
def post_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest choice for each partition of two posts whose digits name books that hold the posts' values, -1 where none does; slot 7 has no book and takes 0 only."""
    return _chosen(spark, sf_dir)[1].select("frame", "part", F.coalesce("choice", F.lit(-1)).alias("choice"))


@query(f"""with {_CHOSEN_SQL}, e as (select 'choices' as book, choice::int as symbol from chosen where choice is not null
  union all select 'slot' || (choice // pow(8, j)::int) % 8, y from t join chosen using (frame, part) where choice is not null and (choice // pow(8, j)::int) % 8 < 7)
select book, symbol, count(*) as n from e group by book, symbol""")
def post_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each book emits each symbol when posts are written: a choice for each partition, then a value for each post that has a book."""
    values, choices = _chosen(spark, sf_dir)
    choices = choices.where("choice is not null")
    slot = F.expr("(shiftright(choice, 3 * j)) & 7")
    written = values.join(choices, ["frame", "part"]).withColumn("slot", slot).where("slot < 7")
    emitted = choices.select(F.lit("choices").alias("book"), F.col("choice").alias("symbol")).unionAll(written.select(F.concat(F.lit("slot"), F.col("slot").cast("string")), "y"))
    return coding.tally(emitted, F.col("book"), F.col("symbol"))


@query(f"""
with recursive {_B}, {_book_sql("r", RISES)}, rises as (select list(y order by entry) as y from r), f as (select frame, list_sort(list(x)) as c from b group by frame),
w as (select frame, c, y, 0 as v, 0.0::double as last, -1 as entry from f, rises
  union all select frame, c, y, v + 1, last + y[e + 1][4], e from (select *, {_near_sql("last")} as e from w where v < 16))
select v::int - 1 as place, entry::int as symbol, count(*) as n from w where v > 0 group by v, entry""")
def loop_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each place of the closed loop emits each entry."""
    of = _frames(spark, sf_dir).select(F.posexplode(prediction.coded_in_loop(F.array_sort("x"), RISES, 4)).alias("place", "s"))
    return coding.tally(of, F.col("place"), F.col("s.entry")).withColumnRenamed("book", "place")


@query(f"""
with {_THRESHOLD}, around as (select frame, k, max(abs(x)) over (partition by frame order by k rows between {RADIUS} preceding and {RADIUS} following) as peak from b)
select frame, k, round(least(greatest(peak, threshold, 1.0649863e-07), 1), 7) as envelope from around join t using (frame, k)""")
def floor_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a floor has to cover in each bin: the largest of fifteen around it, or the masking threshold."""
    rows = bins(_frames(spark, sf_dir))
    of = masking.floor_envelope(rows.select("frame", "k", "x"), masking.thresholds(rows, 64, 44_100.0), RADIUS)
    return of.select("frame", "k", F.round("envelope", 7).alias("envelope"))


@query("""
with h as (select doc_id, hex(encode(text)) as h, (strlen(text) * (doc_id % 97) / 97)::bigint as n from documents where text is not null),
b as (select doc_id, n, [case when n > k then ('0x' || substr(h, 2 * (n - k) - 1, 2))::int else 0 end for k in range(3)] as b from h)
select doc_id, n as size, (n - case when n > 0 and b[1] >= 192 then 1 when n > 1 and b[2] >= 224 and b[1] between 128 and 191 then 2 when n > 2 and b[3] >= 240 and b[2] between 128 and 191 and b[1] between 128 and 191 then 3 else 0 end)::int as valid from b""")
def utf8_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text's bytes, cut somewhere, stop being whole characters."""
    n = F.round(F.octet_length("text") * (F.col("doc_id") % 97) / 97).cast("long")
    cut = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", n.alias("size"), F.substring(F.encode("text", "UTF-8"), F.lit(1), n.cast("int")).alias("data"))
    return cut.select("doc_id", "size", records.valid_up_to(F.col("data")).alias("valid"))


@query("""
with c as (select doc_id, coalesce(source, '') as vendor, [v for v in ['lang=' || lang, 'chars=' || n_chars, 'text=' || left(text, 60)] if v is not null] as comments, doc_id % 11 as cut from documents)
select doc_id, case when cut > 0 then vendor end as vendor, case when cut > 0 then array_to_string(comments, '|') end as comments from c""")
def comment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comment records and back; every eleventh record has lost its last byte and gives null."""
    entries = F.array_compact(F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("chars="), F.col("n_chars").cast("string")), F.concat(F.lit("text="), F.substring("text", 1, 60))))
    of = table(spark, sf_dir, "documents").select("doc_id", records.comment_record(F.coalesce("source", F.lit("")), entries).alias("data"))
    cut = F.when(F.col("doc_id") % 11 == 0, F.substring("data", F.lit(1), F.octet_length("data") - 1)).otherwise(F.col("data"))
    return of.select("doc_id", records.parsed_comments(cut).alias("r")).select("doc_id", "r.vendor", F.array_join("r.comments", "|").alias("comments"))
