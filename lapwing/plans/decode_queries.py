"""Queries of the decode side: vectors from entries, filters from autocorrelation, coded posts, choosers, books, floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.signal import let, lit, packed_float
from lapwing.operators import coding, decode, layout, prediction, quantise, relational
from lapwing.plans.coding_queries import _T, _least_bits_sql, _tallies
from lapwing.plans.layout_queries import _LADDER
from lapwing.plans.vector_queries import _B, _CLASS_SQL, _V, BOOK, CLASSES, FINE, _book_sql, _distance_sql, _frames, _quads, lsp_autocorr
from lapwing.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}
#: A table of 16 entries of four multiplicands, from a rule.
MULTIPLICANDS = [[(5 * e + 3 * d * d) % 11 for d in range(4)] for e in range(16)]
POSTS = [32, 16, 48]
CHOICES = list(range(0, 128, 3))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""
with {_V}, e as (select frame, part, [greatest(least(ceil((x[d] + 0.4e0) / 0.1e0 - 0.5e0), 8), 0) * 0.1e0 - 0.4e0 for d in range(1, 5)] as y from v)
select frame, part, [round(case when frame % 2 = 1 then list_sum(y[1:d]) else y[d] end, 6) + 0 for d in range(1, 5)]::varchar as vector from e""")
def unpack_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of grid entries; those of odd frames with running sums."""
    entry = quantise.lattice_entry(F.col("x"), -0.4, 0.1, 9)
    y = decode.lattice_vector(entry, -0.4, 0.1, 9, 4, F.col("frame") % 2 == 1)
    return _quads(spark, sf_dir).select("frame", "part", _text(y).alias("vector"))


def _text(values: Column) -> Column:
    """Rounded values as one text, as SQL writes a list."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: (F.round(v, 6) + lit(0)).cast("string")), ", "), F.lit("]"))


@query(f"""
with {_V}, {_book_sql("c", BOOK)}, m(entry, t) as (values {", ".join(f"({e}, {r})" for e, r in enumerate(MULTIPLICANDS))}),
a as (select frame, part, arg_min(entry, (round({_distance_sql("x", "y")}, 9), entry)) as entry from v, c group by frame, part)
select frame, part, entry::int as entry, [round(case when part % 2 = 1 then list_sum([0.25e0 * u - 1 for u in t[1:d]]) else 0.25e0 * t[d] - 1 end, 6) + 0 for d in range(1, 5)]::varchar as vector from a join m using (entry)""")
def unpack_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of table entries; those of odd partitions with running sums."""
    near = quantise.nearest_entry(_quads(spark, sf_dir), BOOK)
    return near.select("frame", "part", "entry", _text(decode.table_vector(F.col("entry"), MULTIPLICANDS, -1.0, 0.25, F.col("part") % 2 == 1)).alias("vector"))


@query(f"""
with {_V}, {_book_sql("c", BOOK)}, {_book_sql("f", FINE)},
a as (select frame, part, x, arg_min(entry, (round({_distance_sql("x", "y")}, 9), entry)) as e1 from v, c group by frame, part, x),
l as (select frame, part, e1, x as x1, [x[1] - y[1], x[2] - y[2], x[3] - y[3], x[4] - y[4]] as x from a join c on c.entry = a.e1),
s as (select frame, part, e1, x1, x, arg_min(entry, (round({_distance_sql("x", "y")}, 9), entry)) as e2 from l, f group by frame, part, e1, x1, x)
select frame, part, 0 as stage, e1::int as entry, round(x1[1] * x1[1] + x1[2] * x1[2] + x1[3] * x1[3] + x1[4] * x1[4], 6) as energy from s
union all select frame, part, 1, e2::int, round(x[1] * x[1] + x[2] * x[2] + x[3] * x[3] + x[4] * x[4], 6) from s""")
def cascade_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage of a cascade was given to quantise, from the entries alone."""
    of = quantise.cascade(_quads(spark, sf_dir), [BOOK, FINE]).select("frame", "part", F.explode(decode.replay(F.col("x"), F.col("entries"), [BOOK, FINE])).alias("s"))
    return of.select("frame", "part", "s.stage", "s.entry", F.round(F.aggregate(F.transform("s.target", lambda v: v * v), lit(0), lambda a, v: a + v), 6).alias("energy"))


_R = """w as (select frame, p, angle, case when k = 63 then pi() else (angle + lead(angle) over (partition by frame order by k)) / 2 end - case when k = 0 then 0 else (angle + lag(angle) over (partition by frame order by k)) / 2 end as width from (select frame, x * x as p, (k + 0.5e0) * pi() / 64 as angle, k from b)),
g as (select frame, lag::int as lag, round(sum(p * cos(lag * angle) * width) / pi(), 6) + 0 as r from w, range(9) l(lag) group by frame, lag),
h as (select frame, max(r) filter (lag = 0) as r0, max(r) filter (lag = 1) as r1, max(r) filter (lag = 2) as r2, max(r) filter (lag = 3) as r3 from g group by frame)"""


@query(f"""
with {_B}, {_R},
o as (select *, -r1 / r0 as k1 from h), p as (select *, r0 * (1 - k1 * k1) as v1 from o), q as (select *, -(r2 + k1 * r1) / v1 as k2 from p),
s as (select *, v1 * (1 - k2 * k2) as v2, k1 + k2 * k1 as b1 from q), t as (select *, -(r3 + b1 * r2 + k2 * r1) / v2 as k3 from s)
select frame, round(b1 + k3 * k2, 4) + 0 as a1, round(k2 + k3 * b1, 4) + 0 as a2, round(k3, 4) + 0 as a3, round(v2 * (1 - k3 * k3), 4) + 0 as error from t""")
def prediction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third-order prediction filter of each frame's spectrum."""
    r = lsp_autocorr(spark, sf_dir).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda s: s.r).alias("r"))  # nine lags
    of = r.select("frame", decode.prediction_filter(F.col("r"), 3).alias("f"))
    return of.select("frame", *[(F.round(F.get("f.a", k), 4) + lit(0)).alias(f"a{k + 1}") for k in range(3)], (F.round("f.error", 4) + lit(0)).alias("error"))


@query(f"""
with a as (select vec_id as frame, list_transform(embedding[1:4], lambda u: acos(greatest(-1.0e0, least(1.0e0, cast(u as double))))) as y from embeddings), m as (select frame, cast(j as int) as place, cos(pi() * j / 8.0e0) as w, list_transform(y, lambda u: cos(u)) as c from a, range(8) r(j))
select frame, place, round(1 / greatest(sqrt(greatest((1 - w) / 2 * 4 * pow(c[2] - w, 2) * 4 * pow(c[4] - w, 2) + (1 + w) / 2 * 4 * pow(c[1] - w, 2) * 4 * pow(c[3] - w, 2), 0)), 1.17549435e-38), 3) as weight from m""")
def spectral_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fourth-order line-spectral envelope at eight places."""
    angles = F.transform(F.slice("x", 1, 4), lambda v: F.acos(F.greatest(lit(-1), F.least(lit(1), v))))
    of = _frames(spark, sf_dir).select("frame", angles.alias("y"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("place"))
    return of.select("frame", "place", F.round(decode.spectral_weight(F.col("y"), 4, 8, F.col("place")), 3).alias("weight"))


def _line_sql(x0: int, x1: int, x: int) -> str:
    return f"case when y{x1} < y{x0} then y{x0} - (abs(y{x1} - y{x0}) * {x - x0}) // {x1 - x0} else y{x0} + (abs(y{x1} - y{x0}) * {x - x0}) // {x1 - x0} end"


@query(f"""
with {_B}, {_LADDER}, y as (select frame, max(y) filter (k = 0) as y0, max(y) filter (k = 63) as y64, max(y) filter (k = 32) as y32, max(y) filter (k = 16) as y16, max(y) filter (k = 48) as y48 from l group by frame),
p as (select frame, 32 as x, y32 as y, {_line_sql(0, 64, 32)} as p from y union all select frame, 16, y16, {_line_sql(0, 32, 16)} from y union all select frame, 48, y48, {_line_sql(32, 64, 48)} from y),
v as (select *, y - p as d, 2 * least(256 - p, p) as room, case when 256 - p > p then y else 255 - y end as beyond from p)
select frame, x, p::int as predicted, case when d = 0 then 0 when d > 0 and 2 * d >= room then beyond when d < 0 and -2 * d - 1 >= room then beyond when d > 0 then 2 * d else -2 * d - 1 end::int as value, y::int as height from v""")
def coded_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three posts of each frame as values against their predictions, and the heights that the values give back."""
    ladder = F.transform(layout.on_ladder(F.transform("x", lambda v: F.abs(v))), lambda v: v.cast("int"))
    of_heights = lambda y: decode.coded_posts({x: F.get(y, F.lit(min(x, 63))) for x in decode.all_posts(POSTS, 6)}, POSTS, 6, 256)
    of = _frames(spark, sf_dir).select("frame", F.explode(let(ladder, of_heights)).alias("p"))
    return of.select("frame", "p.*")


def _distortion_sql(posts: list[int]) -> str:
    ends = list(zip([0, *sorted(posts)], [*sorted(posts), 64]))
    at = lambda x: f"y[{min(x, 63) + 1}]"
    return "list_sum([" + " ".join(["pow(y[k + 1] - case", *[f"when k < {b} then {at(a)} + ({at(b)} - {at(a)}) * (k - {a}) / {b - a}.0e0" for a, b in ends], "end, 2) for k in range(64)])"])


@query(f"""
with {_B}, {_LADDER}, y as (select frame, list(y order by k) as y from l group by frame), c as (select frame, [{", ".join(f"round({_distortion_sql(POSTS[:n])} + 20000.0e0 * {n}, 4)" for n in range(4))}] as cost from y)
select frame, (list_position(cost, list_min(cost)) - 1)::int as posts, list_min(cost) as cost from c""")
def post_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of three posts are worth their rate, for each frame."""
    costs = [F.round(layout.post_distortion(F.transform("x", lambda v: F.abs(v)), 64, sorted(POSTS[:n])) + lit(20_000 * n), 4) for n in range(4)]
    of = _frames(spark, sf_dir).select("frame", F.array(*costs).alias("c"))
    return of.select("frame", decode.cheapest_length([F.get("c", n) for n in range(4)]).alias("posts"), F.array_min("c").alias("cost"))


@query(f"""
with c(class, step, bits, stages) as (values {_CLASS_SQL}),
k as (select l_orderkey, class, stages, round(sum((1 + l_linenumber) * pow(l_quantity - round(l_quantity / step) * step, 2)) + 2.0e0 * sum(bits) + case when class = 2 then 40 else 0 end, 6) as cost from lineitem, c group by l_orderkey, class, stages)
select l_orderkey, arg_min(class, (cost, stages, class))::int as class, min(cost) as cost from k group by l_orderkey""")
def class_choice_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of least weighted error, rate and bias for each order: errors weigh more in later lines, class 2 has a bias of 40."""
    q, weight = F.col("l_quantity"), lit(1) + F.col("l_linenumber")
    each = F.array(*[F.struct(F.lit(k).alias("class"), F.lit(n).alias("stages"), (weight * F.pow(q - F.round(q / lit(s)) * lit(s), 2)).alias("error"), lit(2 * b).alias("rate")) for k, (s, b, n) in enumerate(CLASSES)])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(each).alias("c")).select("l_orderkey", "c.*")
    bias = F.when(F.col("class") == 2, lit(40)).otherwise(lit(0))
    costs = rows.groupBy("l_orderkey", "class", "stages").agg(F.sum("error").alias("e"), F.sum("rate").alias("r")).withColumn("cost", F.round(F.col("e") + F.col("r") + bias, 6))
    return relational.cheapest(costs, ["l_orderkey"], F.col("cost"), F.col("stages"), F.col("class")).select("l_orderkey", "class", "cost")


_BOOKS = "held as (select distinct p_partkey % 4 as slot, p_size as y from part where p_partkey % 4 > 0 and p_partkey % 5 < 2)"


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey % 4 > 0 and p_partkey % 5 < 2")
    return part.select((F.col("p_partkey") % 4).alias("slot"), F.col("p_size").alias("y")).distinct()


@query(f"""
with {_BOOKS}, t as (select l_linenumber % 4 as slot, (l_quantity::int) % 60 as y from lineitem), a as (select t.slot, t.y, case when t.slot = 0 then t.y = 0 else h.y is not null end as accepted from t left join held h on h.slot = t.slot and h.y = t.y)
select slot::long as slot, count(*) as n, count_if(accepted)::long as accepted from a group by slot""")
def slot_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many targets each slot's book holds; slot 0 has no book."""
    targets = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("slot"), (F.col("l_quantity").cast("int") % 60).alias("y"))
    leaves = _leaves(spark, sf_dir).select(F.col("slot").cast("long").alias("slot"), "y")
    return decode.accepted(targets, leaves, 0).groupBy("slot").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


@query(f"""
with {_BOOKS}, t as (select l_orderkey, l_linenumber, l_quantity::int as y, a.y is not null as f0, z.y is not null as f1 from lineitem left join held a on a.slot = 1 and a.y = l_quantity::int left join held z on z.slot = 2 and z.y = l_quantity::int),
o as (select l_orderkey, list([f0, f1] order by l_linenumber, y) as f from t group by l_orderkey)
select l_orderkey, coalesce(list_min([c for c in {CHOICES} if list_bool_and([f[j + 1][(c // pow(2, j)::int) % 2 + 1] for j in range(len(f))])]), -1)::int as choice from o""")
def smallest_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest choice whose bits name, line by line of an order, a book that holds the line's quantity; -1 where none does.

    Each line is a number whose bits are the choices that suit it, looked up by its place and its books; an order's lines are combined bit by bit.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("y"))
    held = _leaves(spark, sf_dir).where("slot in (1, 2)").groupBy("y").agg(F.bit_or(F.col("slot")).cast("int").alias("slots"))  # one row for each size
    suited = lines.join(held, "y", "left").select("l_orderkey", F.struct("l_linenumber", "y", F.coalesce("slots", F.lit(0)).alias("slots")).alias("s"))
    rows = suited.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("lines"))  # the lines of one order
    masks = F.transform("lines", lambda s, j: prediction.choice_mask(j, s.slots, CHOICES, 1))
    both = F.aggregate(masks, F.lit(-1).cast("long"), lambda a, m: a.bitwiseAND(m))
    return rows.select("l_orderkey", F.coalesce(prediction.first_choice(both, CHOICES), F.lit(-1)).alias("choice"))


@query("""
with m as (select n_nationkey, 1 + n_nationkey % 3 as submaps from nation)
select s_suppkey, case when submaps <= 1 then 0 when s_suppkey % 8 < 6 then ((s_suppkey % 8) * (n_nationkey + 1)) % submaps else -1 end::int as submap from supplier join m on s_nationkey = n_nationkey""")
def submap_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submap of each channel by its mapping's table of six; 0 where there is one submap, -1 beyond the table."""
    submaps = F.lit(1) + F.col("n_nationkey") % 3
    table_of = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: ((c * (F.col("n_nationkey") + 1)) % submaps).cast("int"))
    of = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return of.select("s_suppkey", F.when(submaps <= 1, F.lit(0)).otherwise(F.coalesce(F.get(table_of, (F.col("s_suppkey") % 8).cast("int")), F.lit(-1))).alias("submap"))


@query("""
with x as (select l_orderkey, l_linenumber, (l_orderkey % 4000001 - 2000000) * pow(2.0e0, (l_suppkey % 41) - 20) as x from lineitem),
s as (select *, floor(log2(abs(x)))::int as e from x where x <> 0), m as (select *, round(abs(x) * pow(2.0e0, 20 - e))::bigint as m, abs(x) * pow(2.0e0, 20 - e) as w from s), o as (select *, m & -m as odd from m)
select l_orderkey, l_linenumber, case when w = m then (case when x < 0 then 2147483648 else 0 end + ((e - 20 + log2(odd)::int + 788)::bigint << 21) + m // odd)::bigint end as bits, case when w = m then x end as value from o
union all select l_orderkey, l_linenumber, 0::bigint, 0.0::double from x where x = 0""")
def float_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as packed floats, and what these unpack to."""
    x = (F.col("l_orderkey") % 4000001 - 2000000) * F.pow(lit(2), F.col("l_suppkey") % 41 - 20)
    of = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", decode.packed_bits(x).alias("bits"))
    return of.withColumn("value", F.when(F.col("bits").isNotNull(), packed_float(F.col("bits"))))


@query(f"""
with recursive {_T}, a as (select distinct symbol from t), k as (select distinct book from t), used as (select book, count(*) as used from t group by book),
d as (select k.book, a.symbol, coalesce(t.n, 1) as n from k cross join a left join t on t.book = k.book and t.symbol = a.symbol), {_least_bits_sql('d')}
select k.book, (select count(*) from a) as entries, used, (select count(*) from a) = 1 as single, used = 0 as unused, 1.0::double as kraft, bits::bigint as bits from k join used using (book) join least using (book)""")
def dense_redesign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books redesigned for every symbol of the common alphabet, seen in a book or not: how many entries, that the tree is full, and that no code takes fewer bits."""
    tallies = _tallies(spark, sf_dir)
    every = tallies.select("symbol").distinct()
    books = tallies.groupBy("book").agg(F.count("*").alias("used"))  # a handful
    dense = coding.code_lengths(coding.dense(tallies, every), None)  # the least bits of any code, however long its words
    of = dense.groupBy("book").agg(F.count("*").alias("entries"), F.sum(F.pow(lit(2), -F.col("length"))).alias("kraft"), F.sum(F.col("n") * F.col("length")).alias("bits"))
    single = F.col("entries") == 1  # its tree counts as full
    return of.join(books, "book").select("book", "entries", "used", single.alias("single"), (F.col("used") == 0).alias("unused"), F.when(single, lit(1)).otherwise(F.col("kraft")).alias("kraft"), "bits")


@query("""
with u as (select p_brand, p_partkey, count(l_partkey) as n from part left join lineitem on l_partkey = p_partkey and l_quantity > 49 and l_discount > 0.08 group by p_brand, p_partkey)
select p_brand, count(*) as entries, count_if(n > 0)::bigint as used, count_if(n > 0) = 0 as unused, count_if(n > 0) = 1 as single from u group by p_brand""")
def book_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as books, parts as entries: which books no entry or a single entry of is used."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("u", F.lit(1))
    of = table(spark, sf_dir, "part").select("p_brand", "p_partkey").join(used, "p_partkey", "left")
    return of.groupBy("p_brand").agg(F.count("*").alias("entries"), F.count("u").alias("used")).select("*", (F.col("used") == 0).alias("unused"), (F.col("used") == 1).alias("single"))


@query("select p_partkey, 0 as \"order\", 44100 as rate, greatest(p_size, 1)::int as map_size, 6 as amplitude_bits, 32 as amplitude_offset, ceil((8 + p_size % 23) / (1 + p_partkey % 5)::double)::int as reads from part")
def envelope_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters of a smooth envelope of a size, and how many vectors of some dimensions its coefficients take."""
    reads = F.ceil((8 + F.col("p_size") % 23) / (1 + F.col("p_partkey") % 5)).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("order"), F.lit(44100).alias("rate"), F.greatest(F.col("p_size"), F.lit(1)).cast("int").alias("map_size"), F.lit(6).alias("amplitude_bits"), F.lit(32).alias("amplitude_offset"), reads.alias("reads"))


@query("""
with h as (select doc_id, strlen(text)::bigint as n, hex(encode(text)) as h from documents where text is not null)
select doc_id, n, n // 2 = n or substr(h, 2 * (n // 2) + 1, 1) not in ('8', '9', 'A', 'B') as halves_valid from h""")
def utf8_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text's bytes, cut in the middle, are valid UTF-8 on both sides."""
    raw, n = F.encode("text", "UTF-8"), F.octet_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    valid = F.is_valid_utf8(F.substring(raw, F.lit(1), half).cast("string")) & F.is_valid_utf8(F.substring(raw, half + 1, n.cast("int")).cast("string"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", n.alias("n"), valid.alias("halves_valid"))
