"""Near copies by SimHash: blocks of wide fingerprints propose pairs, Hamming distance and then the Jaccard similarity of word shingles decide.

The pipeline's rule is five words and similarity 0.8. One 64-bit fingerprint can't carry it: at that similarity about
10 of 64 bits differ, and as many do between texts that share half of their shingles. So fingerprints have BLOCKS
blocks, any of which may be the one that a pair has in common, and CHECK bits more that verify the distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import components, drop_path, saved, shared_dir, with_ids

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Blocks of 16 bits. At similarity 0.8 a bit differs with probability p = 0.152 in long texts and 0.161 at most in short ones (12
#: of 15 shingles), so a pair shares no block with probability (1 - (1 - p)^16)^BLOCKS: 3e-7 and 4e-6. Four of five shingles have
#: p = 0.188; see _fifths.
BLOCKS = 200
#: Bits by which distances are verified, and how many may differ: five standard deviations above the mean of p; 2e-5 of unrelated pairs pass.
CHECK, APART = 128, 40
#: Near members of a block's bucket up to which a class is paired off by Hamming distance alone. What has more is left for rounds
#: by tighter filters, in which so many pairs are, four times as many in each round.
FEW, PAIR_BUCKET = 1, 24
#: Orders in which members are tried, in turn over the blocks: as many kinds of hub. The first round for what is left goes by
#: every ORDERS-th block alone, so by one order: few hubs, as a pair with the same hub is verified once.
ORDERS = 8
#: Earlier members of a bucket that each one is tried with, four times as many in each round; a bucket that has more is left open.
TRIED = 4096
#: Classes in a part of a block, on average.
PART = 500_000
#: Words of parity bits of a set, which rule out pairs without a look at their shingles.
WORDS = 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (3, (16 * BLOCKS + CHECK) // 64), np.uint64)
_FLIP, _TIMES, _AGAIN = _MIX[0], _MIX[1] | np.uint64(1), _MIX[2] | np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct word shingles of a text as sorted XXH64 values, A-Z lower-cased; fewer words than a shingle make one of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set, as bytes: a bit is 1 if it is set in over half of the shingles' hashes, a tie leaves it 0."""
    ones = np.zeros((8, 8 * len(_FLIP)), np.int64)
    for k in range(0, len(shingles), 255):  # as many as a byte can count
        bits = (shingles[k : k + 255, None] ^ _FLIP) * _TIMES
        bits ^= bits >> np.uint64(32)
        bits *= _AGAIN
        bits ^= bits >> np.uint64(29)
        for lane in range(8):
            ones[lane] += ((bits >> np.uint64(lane)) & _LANES).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones > len(shingles), axis=0, bitorder="little")[0]


def _fifths(shingles: np.ndarray) -> list[int]:
    """Keys by which a set of four shingles meets one of five that holds it: its fingerprint's hash, or those of the five without one of theirs."""
    some = [shingles] if len(shingles) == 4 else [np.delete(shingles, k) for k in range(5)] if len(shingles) == 5 else []
    return [xxhash.xxh64_intdigest(fingerprint(s).tobytes(), SEED) for s in some]


def _classes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def _parity_words(sets: list[np.ndarray]) -> np.ndarray:
    """64 * WORDS parity bits of each set, as words. Two sets' differ in no more bits than shingles are in one set only."""
    name, row = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = np.zeros((len(sets), WORDS), np.uint64)
    np.bitwise_xor.at(bits, (row, ((name >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64)), np.uint64(1) << (name & np.uint64(63)))
    return bits


def _alike(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets, of n and m shingles and with parity bits x and y, can be similar. Nothing similar is ruled out."""
    long, short, apart = np.maximum(n, m), np.minimum(n, m), np.bitwise_count(x ^ y).sum(axis=1)
    return (short >= similarity * long - 1e-9) & (apart <= (long + short) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, cls, fp, fifths, n, parity) of every row; th, the text's xxhash64, tells texts apart and cls, a hash of them, shingle sets.

    fp is null without a shingle; n counts shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle) for t in part.column(2)]
                fps = pa.array([fingerprint(s).tobytes() if len(s) else None for s in sets], pa.binary())
                fifths = pa.array([np.array(_fifths(s), np.uint64).view(np.int64) for s in sets], pa.list_(pa.int64()))
                n, parity = pa.array([len(s) for s in sets], pa.int32()), pa.array([x.tobytes() for x in _parity_words(sets)], pa.binary())
                yield pa.record_batch([part.column(0), part.column(1), _classes(sets), fps, fifths, n, parity], ["doc_id", "th", "cls", "fp", "fifths", "n", "parity"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, cls long, fp binary, fifths array<long>, n int, parity binary")


def _sets(docs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(cls, shingles) of the texts whose hash is among texts (th), each class once; shingle sets are worked out for these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t.as_py(), shingle) for t in batch.slice(at, 256).column(1)]
                yield pa.record_batch([_classes(sets), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["cls", "shingles"])

    asked = with_ids(docs.select(F.xxhash64("text").alias("th"), "text"), texts, "th")
    return asked.mapInArrow(run, "cls long, shingles array<long>").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The (a, b) pairs of classes whose shingle sets reach the similarity; each set is met once a pair."""
    pairs = saved(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    path = shared_dir(pairs.sparkSession)
    held = saved(sets_of(ends), path)
    met = pairs.join(held.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    found = saved(met.where(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"))
    drop_path(pairs.sparkSession, path)
    return found


#: What a block's part holds of each class, as arrays: kind and words.
_FIELDS = {"cls": (np.int64, 1), "block": (np.uint16, 1), "bits": (np.uint64, CHECK // 64), "component": (np.int64, 1), "n": (np.int32, 1), "parity": (np.uint64, WORDS)}


def _blocks(sketches: DataFrame, splits: int, every: int = 1) -> DataFrame:
    """(part, cls, block, bits and, where sketches have them, component, n, parity): what is tried in the fingerprints' blocks,
    or in every so many of them, as arrays in one row for each part of a block and batch of a task.
    """
    more = [c for c in ("component", "n", "parity") if c in sketches.columns]
    fields = ["cls", "block", "bits", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            blocks, held = fps[:, : 2 * BLOCKS].copy().view("<u2"), {"cls": batch.column(0).to_numpy(), "bits": fps[:, 2 * BLOCKS :]}
            for k, c in enumerate(more, 2):
                held[c] = np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) if c == "parity" else batch.column(k).to_numpy()
            for at in range(0, BLOCKS, every):
                split, held["block"] = blocks[:, at] % splits, blocks[:, at]
                some = [(at * splits + k, split == k) for k in np.unique(split).tolist()]
                columns = [[held[c][mine].tobytes() for _, mine in some] for c in fields]
                yield pa.record_batch([pa.array([part for part, _ in some], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["part", *fields])

    schema = "part int, " + ", ".join(f"{c} binary" for c in fields)
    return sketches.where("fp is not null").select("cls", "fp", *more).mapInArrow(run, schema)


def _members(group: pa.Table, splits: int) -> tuple[int, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(block's number, what the part holds, by buckets; where each member's bucket begins; how many of its first members each is tried with).

    Members of one component stand together, those of the bucket's largest last, and each is tried with the components before its own.
    """
    of = group.column("part")[0].as_py() // splits
    e = {c: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group.column(c)]).reshape(-1, w) for c, (t, w) in _FIELDS.items() if c in group.column_names}
    e = {c: x[:, 0] if _FIELDS[c][1] == 1 else x for c, x in e.items()}
    mixed = lambda x: (x.view(np.uint64) ^ _FLIP[of % ORDERS]) * _TIMES[of % ORDERS]
    keys = [mixed(e["cls"]), e["block"]]
    if "component" in e:
        by = mixed(e["component"])
        order = np.lexsort((by, e["block"]))
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (np.diff(by[order]) != 0) | (np.diff(e["block"][order]) != 0))))
        size = np.zeros(len(order), np.int64)
        size[order] = np.repeat(np.diff(begin, append=len(order)), np.diff(begin, append=len(order)))
        keys = [keys[0], by, size, e["block"]]
    order = np.lexsort(keys)
    e = {c: x[order] for c, x in e.items()}

    def begins(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))

    first = begins(e["block"])
    return of, e, first, begins(e["block"], e.get("component", e["cls"])) - first


def _try(first: np.ndarray, until: np.ndarray, near: Callable, bucket: int, most: int, through: bool) -> tuple[np.ndarray, ...]:
    """(a, b, near ones of b before a: near pairs, up to `bucket` for each b; near ones and trials of each member; other near ones of those that have more).

    Each member is tried with the first members of its bucket, `most` at most. It stops after `bucket` near ones, or else goes through.
    """
    found, tried, passed, others = [np.zeros((3, 0), np.int64)], np.zeros(len(until), np.int64), np.zeros(len(until), np.int64), np.zeros(len(until), bool)
    behind = np.flatnonzero(until > 0)
    for k in range(min(most, int(until.max(initial=0)))):  # each member with the k-th of its bucket
        behind = behind[(until[behind] > k) & (through | (passed[behind] < bucket))]
        ok = near(first[behind] + k, behind)
        a, b = first[behind[ok]] + k, behind[ok]
        few = passed[b] < bucket
        found.append(np.stack((a[few], b[few], passed[b[few]])))
        others[a[~few]] = True
        tried[behind] = k + 1
        passed[b] += 1
    a, b, before = np.concatenate(found, axis=1)
    return a, b, before, passed, tried, others


def _rows(of: int, e: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, rest: np.ndarray) -> pa.Table:
    pairs = pa.table({"a": e["cls"][a], "b": e["cls"][b], "key": pa.nulls(len(a), pa.int64())})
    key = (np.int64(of) << 16) | e["block"][rest].astype(np.int64)
    return pa.concat_tables([pairs, pa.table({"a": e["cls"][rest], "b": pa.nulls(int(rest.sum()), pa.int64()), "key": key})])


def _few_in_part(group: pa.Table, splits: int, bucket: int) -> pa.Table:
    """(a, b, key): pairs of classes that have a block in common and few other bits apart, without a key, all of those of each
    class that has no more than `bucket` before it; and others and what is near them, each as a, with the bucket's key.
    """
    of, e, first, until = _members(group, splits)
    near = lambda i, j: np.bitwise_count(e["bits"][i] ^ e["bits"][j]).sum(axis=1) <= APART
    a, b, _, passed, tried, rest = _try(first, until, near, bucket, TRIED, True)
    more, unmet = passed > bucket, np.zeros(len(first), bool)
    unmet[first[until > tried]] = True
    rest[a[more[b]]] = True
    return _rows(of, e, a[~more[b]], b[~more[b]], rest | more | unmet[first])


def _near_in_part(group: pa.Table, splits: int, bucket: int, similarity: float = 0.0, most: int = TRIED) -> pa.Table:
    """(a, b, key): pairs of classes of different components that have a block in common, few other bits apart and, where
    n and parity are given, can be similar, without a key; and all members of the buckets in which some class has more to be
    tried with than it was, each as a, with the bucket's key. In these a member's first pair is enough.
    """
    of, e, first, until = _members(group, splits)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(e["bits"][i] ^ e["bits"][j]).sum(axis=1) <= APART
        if "parity" in e:
            some = np.flatnonzero(ok)
            i, j = i[some], j[some]
            ok[some] = _alike(e["n"][i], e["n"][j], e["parity"][i], e["parity"][j], similarity)
        return ok

    a, b, before, _, tried, _ = _try(first, until, near, bucket, most, False)
    left = np.zeros(len(first), bool)
    left[first[until > tried]] = True
    left = left[first]
    once = ~left[a] | (before == 0)
    return _rows(of, e, a[once], b[once], left)


def _met(sketches: DataFrame, every: int, in_part: Callable) -> DataFrame:
    """(a, b, key) of all parts of every so many blocks, written."""
    splits = sketches.count() // PART + 1
    return saved(_blocks(sketches, splits, every).groupBy("part").applyInArrow(lambda group: in_part(group, splits=splits), "a long, b long, key long"))


def _close(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) of classes that can be similar by their sizes and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
            yield batch.select(["a", "b"]).filter(pa.array(_alike(n, m, x, y, similarity)))

    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    mine, other = (sketches.select(F.col("cls").alias(c), F.col("n").alias(size), F.col("parity").alias(bits)) for c, size, bits in (("a", "n", "x"), ("b", "m", "y")))
    return pairs.join(mine, "a").join(other, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def similar_links(sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) links between classes (cls, fp, fifths, n, parity; cls distinct) that keep every group of similar ones connected; sets_of gives shingles.

    Classes meet in the buckets of their blocks, where Hamming distance is verified; sizes and parity bits, then shingles decide. All
    near pairs of a class with few near ones are looked at. Classes with more, and what is near those, meet again in rounds, now
    with sizes and parity bits at hand: only pairs of different groups are tried, and in a bucket that still has many of these each
    member is paired with a hub, then the groups so found go into the next round. Pairs within a group need no look, so nothing
    is lost, and a large cluster of near copies costs its members, not their pairs.
    """
    met = _met(sketches.select("cls", "fp"), 1, partial(_few_in_part, bucket=FEW))
    four = sketches.where("size(fifths) = 1").select(F.col("cls").alias("a"), F.col("fifths")[0].alias("key"))
    five = sketches.where("size(fifths) = 5").select(F.col("cls").alias("b"), F.explode("fifths").alias("key"))
    close = _close(met.where("b is not null").select("a", "b").union(four.join(five, "key").select("a", "b")), sketches, similarity)
    links, at = _verified(close, sets_of, similarity), 0
    left = met.where("b is null").select(F.col("a").alias("cls")).distinct()
    while not left.isEmpty():
        if at > 1:  # what no tighter filter has thinned out
            left = _linkable(sets_of(left), similarity).select("cls")
        named = sketches.join(left, "cls", "left_semi").join(components(links).withColumnRenamed("node", "cls"), "cls", "left")
        named = saved(named.select("cls", "fp", "n", "parity", F.coalesce("component", "cls").alias("component")))
        met = _met(named, 1 if at else ORDERS, partial(_near_in_part, bucket=PAIR_BUCKET << 2 * at, similarity=similarity, most=TRIED << 2 * at))
        links = links.union(_verified(met.where("b is not null").select("a", "b"), sets_of, similarity))
        left = met.where("b is null").select(F.col("a").alias("cls")).distinct() if at else left  # not all blocks are in the first round
        at += 1
    return links


def _parities(sets: DataFrame) -> DataFrame:
    """(cls, parity0, ...): the words of parity bits of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, at = batch.column(1).flatten().to_numpy().view(np.uint64), batch.column(1).offsets.to_numpy()
            bits = _parity_words(np.split(name, at[1:-1] - at[0]))
            yield pa.record_batch([batch.column(0), *map(pa.array, bits.view(np.int64).T)], ["cls", *(f"parity{w}" for w in range(WORDS))])

    return sets.mapInArrow(run, "cls long, " + ", ".join(f"parity{w} long" for w in range(WORDS)))


def _linkable(sets: DataFrame, similarity: float) -> DataFrame:
    """(cls, n, shared, parity0, ...) of the sets (cls, shingles) that can have a similar one among them: n shingles, of which other sets hold `shared`.

    What no other set holds is in no intersection, so a set too many of whose shingles are its own has no partner. When
    such sets are gone others stand alone, so it is repeated while more than one in ten goes. One count of shingles a
    round: variants of one text, each with edits of its own, go without a look at their pairs, and nothing similar is lost.
    """
    spark, path = sets.sparkSession, shared_dir(sets.sparkSession)
    held, before = saved(sets, path), None
    while True:
        alone = held.select("cls", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("of"), F.min("cls").alias("cls")).where("of = 1")
        own = alone.groupBy("cls").agg(F.count("*").alias("own"))
        sizes = held.select("cls", F.size("shingles").alias("n")).join(own, "cls", "left").select("cls", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))
        sizes = saved(sizes.where(F.col("shared") >= F.lit(similarity) * F.col("n") - 1e-9))
        before, after = held.count() if before is None else before, sizes.count()
        if 10 * after >= 9 * before:
            break
        fewer = shared_dir(spark)
        held, before = saved(held.join(sizes.select("cls"), "cls", "left_semi"), fewer), after
        drop_path(spark, path)
        path = fewer
    found = saved(sizes.join(_parities(held.select("cls", "shingles")), "cls"))
    drop_path(spark, path)
    return found


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, th, group, component_id (the smallest doc_id of the group).

    Groups are connected by pairs whose sets of word shingles have that Jaccard similarity or more. Equal sets, as
    those of texts without a word, are one class. Null doc_ids belong to their group but never name it.
    """
    rows = saved(_sketches(docs, shingle))
    classes = saved(rows.groupBy("cls").agg(F.min("doc_id").alias("first"), F.min("th").alias("th")))
    sketches = saved(rows.select("cls", "fp", "fifths", "n", "parity").dropDuplicates(["cls"]))
    sets_of = lambda ends: _sets(docs, saved(classes.join(ends, "cls", "left_semi").select("th")), shingle)
    found = saved(components(similar_links(sketches, sets_of, similarity)))
    grouped = classes.join(found, found.node == classes.cls, "left").select("cls", "first", F.coalesce("component", "cls").alias("group"))
    lowest = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "th", "cls").join(grouped.select("cls", "group").join(lowest, "group"), "cls").select("doc_id", "th", "group", "component_id")
