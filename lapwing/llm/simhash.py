"""SimHash near-duplicates: fingerprints by task-local numpy, links by pigeonhole blocks, groups by components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import components, saved, spare, table, without_rows

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: 64 bits in 4 blocks of 16: two differing bits leave two blocks alone, so close pairs share one of 6 block pairs.
BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints in a block bucket up to which its pairs are joined; larger buckets link through one-bit neighbours.
PAIR_BUCKET = 24
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, word shingles with repeats, majority of the bits of XXH64.

    Fewer words than a shingle make one shingle of them all; no word (or null) gives 0. A tie leaves a bit 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):  # bounded memory on very long texts
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) of every row; th is the text's xxhash64 and fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


def _block_keys(fp: Column) -> Column:
    """The six keys of a fingerprint, each two of its blocks with their numbers on top."""
    mask = (1 << BLOCK_BITS) - 1
    block = [F.shiftrightunsigned(fp, BLOCK_BITS * k).bitwiseAND(F.lit(mask)) for k in range(BLOCKS)]
    return F.array(*[F.lit(k << 2 * BLOCK_BITS).cast("long") + F.shiftleft(block[i], BLOCK_BITS) + block[j] for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))])


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) pairs of distinct fingerprints (column fp) at up to 2 differing bits that keep every group connected.

    Fingerprints meet in the buckets of the blocks they share, and Hamming distance is verified. A bucket of
    a few is joined with itself. A larger one isn't paired off: each member is written under itself and its
    neighbours at one bit, and is linked to the smallest member under the same neighbour. Members at one bit of a
    common neighbour are within two bits of each other, and any two members within two bits have one, so no
    group is split and rows grow with the members, not their pairs.
    """
    if distance > BLOCKS - 2:
        raise ValueError("these blocks hold for at most 2 differing bits")
    spread = distinct.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(spread.join(shared, "key"))
    few = members.where(F.col("n") <= PAIR_BUCKET)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b")
    around = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    many = members.where(F.col("n") > PAIR_BUCKET).select("fp").distinct().select("fp", F.explode(around).alias("near"))
    hubs = many.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("near", "a")
    stars = many.join(hubs, "near").select("a", F.col("fp").alias("b")).where("a < b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return pairs.unionByName(stars).where(close).distinct()


def simhash_groups(docs: DataFrame, fps: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, th, fp, group, component_id (the smallest doc_id reachable over links).

    Equal fingerprints are one class, linked as that. Repeated rows stay repeated; null doc_ids belong to
    their group but never name it, and a group of null doc_ids only has a null component_id. An empty table
    gives no row.
    """
    fps = fps if fps is not None else saved(fingerprints(docs))
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = fingerprint_links(classes.select("fp"))
    found = saved(components(links))  # by fingerprint
    grouped = found.join(classes, found.node == classes.fp).select("component", "fp", "first")
    lowest = grouped.groupBy("component").agg(F.min("first").alias("low"))
    moved = grouped.join(lowest, "component").select("fp", "low", "component")
    # one row for each fingerprint, so that the join with all documents meets no repeated key on this side
    named = classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"), F.coalesce("low", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "th", "fp", "group", "component_id")


def drop_near_duplicates(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row of each group of docs, that of the smallest doc_id, then of the smallest text hash; columns as in docs.

    Groups are those of simhash_groups, or given: doc_id, th and group of every row. Null doc_ids come last, but
    are rows like others; of rows with the same doc_id and text one stays.
    """
    groups = saved((simhash_groups(docs) if groups is None else groups).select("doc_id", "th", "group"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = groups.groupBy("group").agg(F.min(place).alias("best"))
    gone = saved(groups.join(best, "group").where(~place.eqNullSafe(F.col("best"))).select("doc_id", "th").distinct())
    kept = without_rows(docs, gone)
    twice = saved(groups.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"))
    if twice.isEmpty():
        return kept
    single = without_rows(kept, twice)
    doc_id, of = spare("_id", docs), spare("_of", docs)
    several = kept.join(twice.select(F.col("doc_id").alias(doc_id), F.col("th").alias(of)), F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(of)), "left_semi")
    return single.unionAll(several.dropDuplicates(["doc_id", "text"]))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
