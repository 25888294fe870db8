"""How filters interact: what each removes in every order of them, by Lehmer-rank difference arrays.

A document is known by its mask, the filters that it fails. In an order of filters it goes at the first one of its mask. All
orders that begin alike are neighbours in lexicographic order, so the orders in which a mask goes at some step by some filter are
a few intervals of Lehmer ranks. Counts are added where an interval begins and taken off behind its end; prefix sums over
the ranks are then what every order removes at every step.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.common import table, text_of, words_of

FILTERS = "ABCDE"
#: A: fewer words than this.
LEAST_WORDS = 200
#: B: distinct words below this percentage of words. C: A-Z above this percentage of code points.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
#: D: any of these.
SYMBOLS = "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def lehmer_rank(prefix: str, filters: str = FILTERS) -> int:
    """The lexicographic place of the first order that begins with prefix."""
    left, rank = sorted(filters), 0
    for k, letter in enumerate(prefix):
        at = left.index(letter)
        rank += at * factorial(len(filters) - 1 - k)
        left.pop(at)
    return rank


def removal_intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, stop): the ranks [start, stop) of orders in which a mask is removed at the step. Bit k of a mask is filter k."""
    found = []
    for mask in range(1, 1 << len(filters)):
        failed = {f for k, f in enumerate(filters) if mask >> k & 1}
        passed = [f for f in filters if f not in failed]
        for step in range(1, len(passed) + 2):
            for before in permutations(passed, step - 1):
                for f in sorted(failed):
                    start = lehmer_rank("".join(before) + f, filters)
                    found.append((mask, step, start, start + factorial(len(filters) - step)))
    return found


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every row: filters A to D on whole texts. Null text: empty; null lang: the empty part."""
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_of().alias("text")).withColumn("words", words_of(F.col("text")))
    n, capitals = F.size("words"), F.regexp_count("text", F.lit("[A-Z]"))
    fails = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n,
        100 * capitals > MOST_CAPITALS * F.length("text"),
        F.col("text").rlike(SYMBOLS),
    )
    bits: Column = F.lit(0)
    for k, failed in enumerate(fails):
        bits = bits + F.when(failed, 1 << k).otherwise(0)
    return texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, all five.

    E, the bit of value 16, compares doc_ids with the least one of the same text. That least one comes from the same aggregation
    that counts, so copies of one text are summed in their tasks first and never stand together as rows. Rows with a null doc_id
    have no smaller and are none: they pass E. Of several label rows of a doc_id one that says so is enough.
    """
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    flags = flags.select(F.col("doc_id").alias("_label_id"), "is_good", "is_toxic")
    rows = text_masks(docs).join(flags, F.col("doc_id") == F.col("_label_id"), "left")
    kind = ["digest", "part", "mask", "is_good", "is_toxic"]
    rows = rows.withColumn("is_good", F.coalesce("is_good", F.lit(False))).withColumn("is_toxic", F.coalesce("is_toxic", F.lit(False)))
    of_id = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    cells = of_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least.alias("least"))
    # a text's rows are by now one for each part and label
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    cells = cells.withColumn("passing", passing)
    halves = F.array(F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    split = cells.select("part", "is_good", "is_toxic", F.explode(halves).alias("half"))
    some = lambda flag: F.sum(F.when(F.col(flag), F.col("half.n")).otherwise(0))
    return split.groupBy("part", F.col("half.mask").alias("mask")).agg(F.sum("half.n").alias("n"), some("is_good").alias("good"), some("is_toxic").alias("toxic"))


def audit_orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, of (part, mask, n, good, toxic): see audit_filters for the columns.

    Counts have at most 2^filters rows a part, so everything here is bounded by the number of parts. Rows of a part and mask may
    be several; they add up.
    """
    spark, orders, steps = counts.sparkSession, factorial(len(filters)), len(filters)
    intervals = F.broadcast(spark.createDataFrame(removal_intervals(filters), "mask int, step int, start int, stop int"))
    ends = [F.struct(F.col(at).alias("rank"), *[(sign * F.col(c)).alias(c) for c in COUNTS]) for at, sign in (("start", 1), ("stop", -1))]
    marks = counts.join(intervals, "mask").select("part", "step", F.explode(F.array(*ends)).alias("end")).select("part", "step", "end.*")
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col("n")).otherwise(0)) for k in range(steps)]
    alone = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(steps)]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    grid = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    changes = grid.unionByName(marks).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    up_to = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # one row for each order
    found = changes.select("part", "step", "rank", *[F.sum(c).over(up_to).alias(c) for c in COUNTS]).where(F.col("rank") < orders)
    names = F.array(*[F.lit("".join(p)) for p in permutations(sorted(filters))])
    found = found.withColumn("filter_order", F.get(names, F.col("rank"))).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    found = found.join(totals, "part").withColumn("place", F.instr(F.lit(filters), F.col("letter")) - 1)
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return found.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"),
        (F.get("fails", F.col("place")) - F.col("n")).alias("redundant"),
        F.get("alone", F.col("place")).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (lang), order of the filters A to E and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A: under 200 words; B: distinct words under half of the words; C: A-Z over 3 % of the code points; D: one of ``#$%&*|``;
    E: the text of a smaller doc_id, table-wide. Null texts are empty ones, which fail A, and E if another empty one stands
    before. Null langs are the part of the empty lang. Repeated rows count as documents each, and as none is smaller than the other
    they pass E together. Null doc_ids pass E and have no label; docs' other columns are ignored. Of no document there is no part and no row.
    """
    return audit_orders(mask_counts(docs, labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with recursive flags as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id
), texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    min(doc_id) over (partition by coalesce(text, '')) as first from documents
), failing as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    concat(
      case when len(words) < 200 then 'A' else '' end,
      case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end,
      case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end,
      case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end,
      case when t.doc_id > first then 'E' else '' end) as failed
  from texts t left join flags f on t.doc_id = f.doc_id
), counts as (
  select part, failed, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from failing group by part, failed
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as letter
), orders as (
  select '' as filter_order union all select filter_order || letter from orders, letters where not contains(filter_order, letter)
), steps as (
  select filter_order, s.step::int as step, filter_order[s.step] as letter, filter_order[1:s.step - 1] as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as step) s where length(filter_order) = 5
), found as (
  select part, filter_order, step, letter,
    sum(case when contains(failed, letter) and translate(failed, before, '') = failed then n else 0 end) as removed,
    sum(case when contains(failed, letter) and translate(failed, before, '') <> failed then n else 0 end) as redundant,
    sum(case when failed = letter then n else 0 end) as unique_fails,
    sum(case when translate(failed, before || letter, '') = failed then n else 0 end) as kept,
    sum(case when contains(failed, letter) and translate(failed, before, '') = failed then good else 0 end) as good_lost,
    sum(case when contains(failed, letter) and translate(failed, before, '') = failed then toxic else 0 end) as toxic_lost
  from counts, steps group by part, filter_order, step, letter
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley
from found
"""
