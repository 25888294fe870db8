"""Importance resampling towards a target distribution: hashed n-gram weights, Gumbel scores, an exact cutoff by bracketing.

Features of all documents and of all target texts are counted in hash buckets, in arrays inside the tasks and then by Spark. A
bucket's gain is the logarithm of its share among target features over that among the documents'. A document's weight is
the sum of its features' gains; with Gumbel noise from its id, the highest scores are a draw without replacement in proportion
to the weights' exponentials. The cutoff isn't found by sorting all scores: a quantile sketch brackets it, exact counts
outside the bracket say whether it holds the cutoff (if not, it is widened), and only the rows in the bracket are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import drop_path, ranked, saved, shared_dir, table, text_of
from lapwing.llm.spans import texts_of, words_of

#: Words of a run, least and most; buckets of features; documents of fewer words aren't drawn; percentage drawn; seed of the noise.
RUNS, BUCKETS, LEAST_WORDS, PERCENT, SEED = (1, 1), 10_000, 20, 10, 2024
#: Half the bracket's first width, as a share of rows; it doubles until the bracket holds the cutoff.
BRACKET = 0.002
ROWS = 512
#: Bytes of a word that are hashed for all words at once; what is longer is hashed word by word.
STRIDE = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes between words: ASCII but digits and a-z (A-Z are lower-cased before).
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
#: CRC-32 by bytes, from its polynomial, reflected.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> 1) ^ np.where(_CRC & 1, np.uint32(0xEDB88320), np.uint32(0))
_FULL = np.uint32(0xFFFFFFFF)


def crc32_spans(data: bytes, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 of each span of data, going on from the CRC-32s before; all spans are read byte by byte together."""
    state = np.full(len(starts), _FULL, np.uint32) if before is None else before ^ _FULL
    flat = np.frombuffer(data, np.uint8)
    live, at = np.flatnonzero(sizes > 0), 0
    while len(live) and at < STRIDE:
        now = state[live]
        state[live] = (now >> 8) ^ _CRC[(now ^ flat[starts[live] + at]) & 255]
        at += 1
        live = live[sizes[live] > at]
    state ^= _FULL
    for k in live.tolist():
        state[k] = zlib.crc32(data[starts[k] + at : starts[k] + sizes[k]], int(state[k]))
    return state


def run_buckets(column: pa.Array, runs: tuple[int, int] = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text's number, words of each text) of a string column without nulls, runs of a length together."""
    data, offsets = texts_of(column)
    data = data.translate(_LOWER)
    starts, sizes, bounds = words_of(data, offsets, _BETWEEN)
    text = np.repeat(np.arange(len(column)), np.diff(bounds))
    found, owners, crc, whole = [], [], None, np.arange(len(starts))
    for n in range(1, runs[1] + 1):
        if n == 1:
            crc = crc32_spans(data, starts, sizes)
        else:  # runs that end inside their text go on by a space and the next word
            inside = np.flatnonzero(whole + n - 1 < len(starts))
            inside = inside[text[whole[inside]] == text[whole[inside] + n - 1]]
            whole = whole[inside]
            spaced = crc[inside] ^ _FULL
            spaced = ((spaced >> 8) ^ _CRC[(spaced ^ 32) & 255]) ^ _FULL
            crc = crc32_spans(data, starts[whole + n - 1], sizes[whole + n - 1], spaced)
        if n >= runs[0]:
            found.append((crc % np.uint32(buckets)).astype(np.int64))
            owners.append(text[whole])
    return np.concatenate(found), np.concatenate(owners), np.diff(bounds)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def bucket_counts(texts: DataFrame, runs: tuple[int, int] = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of texts (column text): an array of a task each, summed by Spark, `buckets` rows in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for part in _parts(batches):
            counts += np.bincount(run_buckets(part.column(0), runs, buckets)[0], minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    found = texts.select(text_of().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of target features over that of source features."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000.0 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise times 1000, rounded down, from the first 32 bits of sha256 of the seed and the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: np.ndarray, runs: tuple[int, int] = RUNS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs."""
    known = docs.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = known.value
        for part in _parts(batches):
            bucket, owner, n_words = run_buckets(part.column(1), runs, len(gain))
            n = np.bincount(owner, minlength=part.num_rows)
            weight = np.zeros(part.num_rows, np.int64)
            for k in range(0, len(owner), 1 << 20):  # whole numbers, summed without rounding
                np.add.at(weight, owner[k : k + (1 << 20)], gain[bucket[k : k + (1 << 20)]])
            yield pa.record_batch([part.column(0), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    found = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _order() -> list[Column]:
    """Highest score first, ties by doc_id, null last; what may remain are rows of one doc_id and score, by their numbers and place."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), F.col("place").asc()]


def _not_behind(row) -> Column:
    """Whether a row comes before the given one in _order(), or is it."""
    doc_id = F.coalesce("doc_id", F.lit(2**63 - 1))
    mine = F.struct(-F.col("score"), F.col("doc_id").isNull(), doc_id, "n_features", "weight", "place")
    theirs = (-row.score, row.doc_id is None, 2**63 - 1 if row.doc_id is None else row.doc_id, row.n_features, row.weight, row.place)
    kinds = ("long", "boolean", "long", "long", "long", "long")
    return mine <= F.struct(*[F.lit(x).cast(k) for x, k in zip(theirs, kinds)])


def cutoff_row(rows: DataFrame, k: int, bracket: float = BRACKET):
    """The k-th row of rows (at least k) in _order(), by a bracket of scores around it that a quantile sketch proposes.

    Rows above and in the bracket are counted exactly. It holds the cutoff if fewer than k rows are above it and at least k above or
    in it; else it is widened, in the end to all scores. Only its rows are sorted.
    """
    n, half = rows.count(), bracket
    while True:
        at = 1 - (k - 0.5) / n
        ends = [max(0.0, at - half), min(1.0, at + half)]
        low, high = rows.agg(F.percentile_approx("score", ends, max(100, int(2 / half)))).first()[0]
        low, high = (low if ends[0] > 0 else None), (high if ends[1] < 1 else None)
        above = F.lit(False) if high is None else F.col("score") > high
        inside = ~above & (F.lit(True) if low is None else F.col("score") >= low)
        counted = rows.agg(F.count(F.when(above, 1)).alias("above"), F.count(F.when(inside, 1)).alias("inside")).first()
        if counted.above < k <= counted.above + counted.inside:
            return ranked(rows.where(inside), *_order()).where(F.col("rank") == k - counted.above).first()
        half *= 2


def resample(docs: DataFrame, target: DataFrame, runs: tuple[int, int] = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null for rows that aren't drawn.

    Of the N rows with at least least_words words the floor(percent N / 100) of highest score are drawn, ties by smaller doc_id.
    Null texts are empty, have weight 0 and are drawn never; null doc_ids share one noise, that of an empty id, and
    come last among ties. Repeated rows are rows of their own with equal scores and ranks one after the other. Of an empty table
    no row comes; without target texts every gain is by the documents' shares alone.
    """
    spark, paths = docs.sparkSession, [shared_dir(docs.sparkSession)]
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    rows = saved(scored(docs, gain, runs, seed).withColumn("place", F.monotonically_increasing_id()), paths[0])
    able = rows.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = cutoff_row(able, k)
    drawn = (F.col("n_words") >= least_words) & _not_behind(last)
    return ranked(rows.where(drawn), *_order()).select(*columns, "rank").unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with recursive crc(k, i, c) as (
  select 0, i, i::ubigint from range(256) r(i)
  union all select k + 1, i, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end from crc where k < 8
), steps as (
  select list(c order by i) as step from crc where k = 8
), texts as (
  select true as mine, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, row_number() over () as row from documents
  union all select false, null, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), -row_number() over () from benchmark
), split as (
  select mine, doc_id, row, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from texts
), counted as (
  select mine, row, word, count(*) as n from (select mine, row, unnest(words) as word from split) group by all
), named as (
  select word, list_transform(range(0, octet_length(encode(word)), 1), lambda j: ('0x' || hex(encode(word))[(2 * j + 1)::int:(2 * j + 2)::int])::ubigint) as bytes
  from (select distinct word from counted)
), hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::ubigint, bytes), lambda c, b: xor(c // 256, step[(xor(c, b) % 256 + 1)::int])), 4294967295::ubigint) % 10000 as bucket from named, steps
), features as (
  select mine, row, bucket, n from counted join hashed using (word)
), sums as (
  select bucket, coalesce(sum(n) filter (where mine), 0) as s, coalesce(sum(n) filter (where not mine), 0) as t from features group by bucket
), gained as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from sums) + 10000)::double / ((s + 1)::double * ((select sum(t) from sums) + 10000)::double)))::bigint as gain from sums
), weighted as (
  select row, sum(n * gain)::bigint as weight from features join gained using (bucket) where mine group by row
), results as (
  select doc_id, row, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from split left join weighted using (row) where mine
), drawn as (
  select row, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as rank from results where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from drawn) then rank end as rank from results left join drawn using (row)
"""
