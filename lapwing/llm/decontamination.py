"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

DataFrame operations only. A test item counts as leaked into a document that holds at least THRESHOLD of
the item's distinct word shingles, in whatever place and case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import saved, table, text_of, with_ids, without_texts, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Sketch rows, of two longs each, that may be broadcast (32 MB); a larger index is joined by shuffle.
BROADCAST_SKETCH = 2_000_000


def _shingles(words: Column, width: Column | int) -> Column:
    """All runs of width words, space-joined, as an array; empty if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width
    places = F.when((width > 0) & (F.size(words) >= width), F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, width), " "))


def item_index(items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, width, shingles, n, need, sketch) of each item that has a word.

    Items of fewer words than a shingle are one shingle of them all. Items fall into partitions by their
    number n of distinct shingles, upper bounds doubling; the sketch is the bottom-k MinHash, k being what a
    partition's bound allows to miss, plus one. A document that holds need of the n shingles then holds one
    of the sketch for certain, so the search loses nothing, while sketches stay a fifth to two fifths of the shingles.
    """
    words = words_of(F.lower(text_of()))
    rows = items.select("item_id", words.alias("words")).where(F.size("words") > 0).withColumn("width", F.least(F.lit(shingle), F.size("words")))
    rows = rows.select("item_id", "width", F.array_distinct(_shingles(F.col("words"), F.col("width"))).alias("shingles")).withColumn("n", F.size("shingles"))
    bound = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    keep = (F.floor(bound * F.lit(1 - threshold) + 1e-9) + 1).cast("int")
    hashes = F.sort_array(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(s))))
    return rows.select("*", F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int").alias("need"), F.slice(hashes, F.lit(1), keep).alias("sketch"))


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): every pair in which the document holds need of the item's shingles.

    Null and empty texts hold nothing and items without words are found nowhere; repeated items are found
    each under its item_id; for repeated doc_ids the row with the most shingles found counts. Documents with a null
    doc_id are not reported. Either table may be empty.
    """
    index = saved(item_index(items, shingle, threshold))
    widths = [r.width for r in index.select("width").distinct().collect()]  # at most `shingle` values
    sketch = index.select("item_id", F.explode("sketch").alias("hash"))
    if sketch.count() <= BROADCAST_SKETCH:
        sketch = F.broadcast(sketch)
    words = words_of(F.lower(text_of()))
    named = docs.where("doc_id is not null").select("doc_id", "text")
    hashed = F.concat(*[F.transform(_shingles(F.col("words"), w), lambda s: F.xxhash64(s)) for w in widths] or [F.array().cast("array<bigint>")])
    seen = named.select("doc_id", words.alias("words")).select("doc_id", F.explode(hashed).alias("hash"))
    candidates = saved(seen.join(sketch, "hash").select("doc_id", "item_id").distinct())
    texts = with_ids(named, candidates.select("doc_id").distinct()).select("doc_id", words.alias("words"))
    # the words of a document meet its candidates, and those their shingles; only documents with a candidate are read on
    pairs = texts.join(candidates, "doc_id").join(index.select("item_id", "width", "shingles", "n", "need"), "item_id")
    found = pairs.withColumn("n_found", F.size(F.array_intersect("shingles", _shingles(F.col("words"), F.col("width")))))
    return found.where("n_found >= need").groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_shingles"), F.max("n_found").cast("long").alias("n_found"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows into whose text an item has leaked, null and repeated doc_ids included; columns as in docs."""
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = saved(leaks(by_text, items).select(F.col("doc_id").alias("th")).distinct())
    return without_texts(docs, found)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
with i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w from benchmark),
items as (select distinct item_id, least(5, len(w)) as width, unnest([array_to_string(w[k:k + least(5, len(w)) - 1], ' ') for k in range(1, len(w) - least(5, len(w)) + 2)]) as s from i where len(w) > 0),
sizes as (select item_id, count(*) as n from items group by item_id),
d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
held as (select distinct doc_id, width, unnest([array_to_string(w[k:k + width - 1], ' ') for k in range(1, len(w) - width + 2)]) as s from d, (select distinct width from items) where len(w) >= width)
select h.doc_id, i.item_id, any_value(z.n)::bigint as n_shingles, count(*)::bigint as n_found
from held h join items i on h.s = i.s and h.width = i.width join sizes z on z.item_id = i.item_id
group by h.doc_id, i.item_id having count(*) >= ceil(any_value(z.n) * 0.8 - 1e-9)
"""
