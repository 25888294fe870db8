"""Removal of repeated byte strings by distributed prefix doubling.

A position's rank at a length is a name that equal strings of that length share. Names double within a
task while a text is read (8, 16, ... bytes, up to half the threshold), since no string crosses a document.
Then Spark takes over. The positions reranked first are a content-defined sample, the smallest name of each
window: every string of threshold length holds its window's whole, so equal strings share that sample, and where it is
unique in the corpus nothing of its window can repeat. Positions that are left, and only these, get the pair of ranks at
offset half the threshold, are reranked by that pair, and those still not unique start a repeated string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import drop_path, saved, shared_dir, table, text_of, with_ids

THRESHOLD = 400
#: Positions of a text that are worked on at once.
SLAB = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names."""
    h = a * _A + (b ^ (b >> np.uint64(29))) * _B
    h ^= h >> np.uint64(32)
    return h


def names(text: bytes, length: int) -> np.ndarray:
    """64-bit names of the length-byte strings at every position, by doubling from 8 bytes; the last step overlaps."""
    h = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,)).astype(np.uint64)
    have = 8
    while have < length:
        step = min(have, length - have)
        h = _pair(h[:-step], h[step:])
        have += step
    return h


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest or largest of each width neighbours, by doubling."""
    of, k = (np.minimum if least else np.maximum), 1
    while 2 * k <= width:
        x = of(x[:-k], x[k:])
        k *= 2
    return of(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def windows(text: bytes, threshold: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """Runs of positions whose window has the same smallest name: (start, length, name, hash of all bytes that the run's
    strings cover, whether that name stands more than once in the text). Runs cover every string of threshold bytes."""
    half = threshold - threshold // 2
    width = threshold - half + 1
    for base in range(0, max(0, len(text) - threshold + 1), SLAB):
        slab = text[base : base + SLAB + threshold - 1]
        h = names(slab, half)
        low = _slide(h, width, True)
        cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(low)]))
        far = np.zeros(width - 1, np.uint64)
        sampled = h[h == _slide(np.concatenate((far, low, far)), width, False)]
        values, counts = np.unique(sampled, return_counts=True)
        often = np.isin(low[starts], values[counts > 1])
        for s, e, name, twice in zip(starts.tolist(), ends.tolist(), low[starts].view(np.int64).tolist(), often.tolist()):
            yield base + s, e - s, name, xxhash.xxh3_64_intdigest(slab[s : e + threshold - 1]) - (1 << 63), twice


def _runs(docs: DataFrame, threshold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = list(windows(text.as_buffer().to_pybytes(), threshold))
                ids += [text_id] * len(got)
                rows += got
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(ids, pa.binary()), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["text_id", "start", "len", "name", "span", "twice"])

    return docs.mapInArrow(run, "text_id binary, start int, len int, name long, span long, twice boolean")


def _rank_pairs(texts: DataFrame, threshold: int) -> DataFrame:
    """texts (text, runs) to positions: (rep, name, rank, place, open): rank names the pair of ranks at a position
    and half the threshold on."""
    half = threshold - threshold // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, runs in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_buffer().to_pybytes()
                for k in range(0, len(runs), 4096):
                    some = sorted(runs[k : k + 4096], key=lambda r: r["start"])
                    out = []
                    for r in some:  # a run with its strings is short, but for periodic text, which goes in slabs
                        for at in range(r["start"], r["start"] + r["len"], SLAB):
                            n = min(SLAB, r["start"] + r["len"] - at)
                            h = names(text[at : at + n + threshold - 1], half)
                            out.append((r, at, _pair(h[:n], h[threshold - half : threshold - half + n])))
                    size = [len(x) for _, _, x in out]
                    yield pa.record_batch(
                        [
                            pa.array(np.repeat([r["rep"] for r, _, _ in out], size), pa.int64()),
                            pa.array(np.repeat([r["name"] for r, _, _ in out], size), pa.int64()),
                            pa.array(np.concatenate([x for _, _, x in out]).view(np.int64), pa.int64()),
                            pa.array(np.concatenate([np.arange(at, at + len(x)) for _, at, x in out]), pa.int32()),
                            pa.array(np.repeat([r["open"] for r, _, _ in out], size), pa.bool_()),
                        ],
                        ["rep", "name", "rank", "place", "open"],
                    )

    return texts.mapInArrow(run, "rep long, name long, rank long, place int, open boolean")


def repeated_stretches(docs: DataFrame, kept: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """(text_id, stretches): for each text of docs (text_id: binary, text) with a repeated string, the byte ranges that
    such strings cover, which may overlap. kept gets the folders that the rows are still read from.

    Rows of the same text are occurrences of their own, so a text that stands twice is covered wherever it has
    threshold bytes. Equal stretches of text in equal surroundings are settled by one grouping; only one
    representative of the others goes on to single positions. Repeats of any number make rows by their places, never by pairs.
    """
    if threshold < 16:
        raise ValueError("names start at 8 bytes: the threshold is 16 at least")
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)

    def held(rows: DataFrame) -> DataFrame:
        kept.append(shared_dir(spark))
        return saved(rows, kept[-1])

    runs = saved(_runs(docs, threshold), path)
    repeated = runs.groupBy("name").agg(F.count("*").alias("n"), F.max("twice").alias("t")).where("n > 1 or t").select("name")
    left = held(runs.join(repeated, "name"))
    drop_path(spark, path)
    spans = left.groupBy("name", "span").agg(F.count("*").alias("n"), F.min(F.struct("text_id", "start", "len")).alias("first"), F.max("twice").alias("twice"))
    spans = held(spans.withColumn("rep", F.monotonically_increasing_id()))
    whole = left.join(spans.where("n > 1").select("name", "span"), ["name", "span"])
    whole = whole.select("text_id", F.col("start").alias("a"), (F.col("start") + F.col("len") - 1 + threshold).alias("b")).distinct()

    unsure = spans.groupBy("name").agg(F.count("*").alias("spans"), F.max("twice").alias("t"), F.min("n").alias("least")).where("(spans > 1 or t) and least = 1").select("name")
    member = F.struct("rep", "name", F.col("first.start").alias("start"), F.col("first.len").alias("len"), (F.col("n") == 1).alias("open"))
    reps = held(spans.join(unsure, "name").groupBy(F.col("first.text_id").alias("text_id")).agg(F.collect_list(member).alias("runs")))
    once = with_ids(docs, reps.select("text_id"), "text_id").groupBy("text_id").agg(F.first("text").alias("text"))
    pairs = _rank_pairs(once.join(reps, "text_id").select("text", "runs"), threshold)
    shared = pairs.groupBy("name", "rank").agg(F.count("*").alias("n")).where("n > 1").select("name", "rank")
    open_ = pairs.where("open").join(shared, ["name", "rank"]).select("rep", "place")
    at = open_.groupBy("rep").agg(F.sort_array(F.collect_list("place")).alias("places"))  # the places of one run
    start = F.expr("filter(places, (p, i) -> i = 0 or p > places[i - 1] + 1)")
    end = F.expr(f"transform(filter(places, (p, i) -> i = size(places) - 1 or places[i + 1] > p + 1), p -> p + {threshold})")
    single = at.join(spans.select("rep", "first.text_id"), "rep").select("text_id", F.explode(F.arrays_zip(start.alias("a"), end.alias("b"))).alias("r")).select("text_id", "r.a", "r.b")
    return whole.unionByName(single).groupBy("text_id").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("stretches"))


def dedup_strings(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, kept (the remaining bytes, concatenated), n_bytes, n_removed, n_spans.

    Every byte covered by a threshold-byte string that also starts anywhere else goes, in all places, as judged on the
    input. Null is the empty text; texts shorter than the threshold stay whole; doc_ids may be null or repeated,
    repeated rows being repeats of one another. An empty table gives no row.
    """
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("text_id", F.unhex(F.md5("text")))
    kept: list[str] = []
    found = saved(repeated_stretches(texts.select("text_id", "text"), kept, threshold))
    for path in kept:
        drop_path(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, stretches in zip(batch.column(1), batch.column(2).to_pylist()):
                text, merged, kept, at = text.as_buffer().to_pybytes(), [], [], 0
                for r in stretches or ():
                    if merged and r["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["b"])
                    else:
                        merged.append([r["a"], r["b"]])
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rows.append((b"".join(kept), len(text), sum(b - a for a, b in merged), len(merged)))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.record_batch([batch.column(0), pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return texts.join(found, "text_id", "left").select("doc_id", "text", "stretches").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_strings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeat"))
