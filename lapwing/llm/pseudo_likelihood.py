"""Language-model scoring by masked pseudo-likelihood: a small network predicts every word from both sides.

Words are counted over the whole corpus. The network is trained in numpy within Spark tasks, each on all words of its
documents, and the tasks' weights are averaged by Spark in a tree, round after round. A word's probability is the
product along a tree of softmaxes, sixteen branches wide and three deep. Words beyond the network's vocabulary
share buckets, and theirs is the bucket's probability times their share of it by the corpus' counts, so what is gathered grows
with the corpus. Words are known by 64-bit names throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import drop_path, saved, shared_dir, table, text_of
from lapwing.llm.spans import Table, names, texts_of, words_of

#: Ids: 0 beyond the ends, then frequent words, then name buckets for all other words. Three base-BRANCH digits each.
VOCABULARY, BUCKETS, BRANCH = 4096, 256, 16
#: The last hidden unit is always 1, so that weights for it are biases.
SIDE, HIDDEN = 2, 16
OFFSETS = (-2, -1, 1, 2)
#: Every run of SEGMENT words is trained on, each in one of the rounds.
SEGMENT, ROUNDS = 64, 2
RATE, BATCH = 0.05, 16_384
#: Partial models that one task averages.
FAN_IN = 64
#: Words that a task counts before it writes counts down.
COUNTED = 2_000_000
ROWS = 256
_SHAPES = {"side": (2 * SIDE, VOCABULARY, HIDDEN), "top": (BRANCH, HIDDEN), "middle": (BRANCH, BRANCH, HIDDEN), "low": (BRANCH**2, BRANCH, HIDDEN)}


def word_names(words: list[str]) -> list[int]:
    """The names of words, as signed longs; words are lower-cased before they come here."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(w) for w in raw], np.int64)
    return names(b"".join(raw), np.cumsum(sizes) - sizes, sizes)[0].view(np.int64).tolist()


def _named(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(name of each word of a column of texts, words before each text and in all)."""
    data, offsets = texts_of(column)
    starts, sizes, first = words_of(data, offsets)
    return names(data, starts, sizes)[0], first


def _lower(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.lower(text_of()).alias("text"))


def _parts(docs: DataFrame) -> int:
    """Into how many parts names are dealt by their value; grows with the input, as its partitions do."""
    return max(8, docs.rdd.getNumPartitions())


def _dealt(name: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by part, bounds of each part in it)."""
    part = ((name >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), pa.array(values)).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))


def count_words(docs: DataFrame) -> DataFrame:
    """(name, count, part) of every lower-cased word of all documents, summed in tasks before counts are shuffled.

    A task's counts travel as arrays, one for each part of the names, and each part is summed on its own.
    """
    parts = _parts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            name, n = np.unique(np.concatenate(held), return_counts=True)
            order, bounds = _dealt(name, parts)
            return pa.record_batch([pa.array(np.arange(parts, dtype=np.int32)), _lists(name[order].view(np.int64), bounds), _lists(n[order], bounds)], ["part", "names", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(_named(batch.column(0).slice(at, ROWS))[0])
                if sum(map(len, held)) >= COUNTED:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    def add(group: pa.Table) -> pa.Table:
        part = group.column("part")[0]
        every = np.concatenate([c.flatten().to_numpy() for c in group.column("names").chunks])
        name, which = np.unique(every, return_inverse=True)
        n = np.bincount(which, np.concatenate([c.flatten().to_numpy() for c in group.column("counts").chunks]), len(name)).astype(np.int64)
        return pa.table({"part": pa.array([part.as_py()] * len(name), pa.int32()), "name": pa.array(name, pa.int64()), "count": pa.array(n, pa.int64())})

    packed = _lower(docs).mapInArrow(run, "part int, names array<long>, counts array<long>")
    return saved(packed.groupBy("part").applyInArrow(add, "part int, name long, count long"))


def count_vocabulary(counts: DataFrame) -> tuple[list[int], np.ndarray]:
    """The most frequent words' names, ties by name, and how often each id stands in all documents; counts as of count_words."""
    top = counts.orderBy(F.desc("count"), "name").limit(VOCABULARY - BUCKETS - 1).collect()
    of_id = np.zeros(VOCABULARY)
    of_id[1 : len(top) + 1] = [r["count"] for r in top]
    rare = VOCABULARY - BUCKETS
    for r in counts.groupBy(F.pmod("name", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("count").alias("n")).collect():  # BUCKETS rows
        of_id[rare + r.bucket] = r.n
    for r in top:
        of_id[rare + r.name % BUCKETS] -= r["count"]
    return [r.name for r in top], of_id


class Ids:
    """Names of words to ids: a table of the vocabulary, and buckets for all others."""

    def __init__(self, vocabulary: list[int]) -> None:
        name = np.array(vocabulary, np.int64).view(np.uint64)
        self.table = Table(VOCABULARY)
        self.table.add(name, name)

    def __call__(self, name: np.ndarray) -> np.ndarray:
        code = self.table.find(name, name)
        bucket = (name % np.uint64(BUCKETS)).astype(np.int32) + (VOCABULARY - BUCKETS)
        return np.where(code >= 0, code + 1, bucket).astype(np.int16)


def _spaced(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all texts' ids in a row, SIDE zeros before, between and behind the texts; the place of each word in it)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(ids)) + SIDE * (text + 1)
    out = np.zeros(len(ids) + SIDE * len(first), np.int16)
    out[place] = ids
    return out, place


def new_model(counts: np.ndarray | None = None, seed: int = 7) -> dict[str, np.ndarray]:
    """side: a row for each place in the window and id; then the tree's three levels, biased to the words' frequencies."""
    mass = (np.ones(VOCABULARY) if counts is None else np.maximum(counts, 0) + 0.5).reshape(BRANCH, BRANCH, BRANCH)
    model = {k: np.zeros(shape, np.float32) for k, shape in _SHAPES.items()}
    model["side"][:, :, :-1] = np.random.default_rng(seed).standard_normal((2 * SIDE, VOCABULARY, HIDDEN - 1)) * 0.1
    model["top"][:, -1] = np.log(mass.sum((1, 2)) / mass.sum())
    model["middle"][:, :, -1] = np.log(mass.sum(2) / mass.sum((1, 2))[:, None])
    model["low"][:, :, -1] = np.log(mass / mass.sum(2)[:, :, None]).reshape(-1, BRANCH)
    return model


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of each run of equal keys."""
    cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    starts = np.concatenate(([0], cuts))
    return zip(sorted_keys[starts].tolist(), starts.tolist(), np.concatenate((cuts, [len(sorted_keys)])).tolist())


def _forward(model: dict, around: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden units, probabilities of the branches at all three levels) of words whose ids are in order of id >> 4."""
    h = model["side"][0][around[0]]
    for k in range(1, 2 * SIDE):
        h += model["side"][k][around[k]]
    np.tanh(h, out=h)
    h[:, -1] = 1
    p = np.empty((3, len(ids), BRANCH), np.float32)
    np.matmul(h, model["top"].T, out=p[0])
    for a, s, e in _runs(ids >> 8):
        np.matmul(h[s:e], model["middle"][a].T, out=p[1, s:e])
    for b, s, e in _runs(ids >> 4):
        np.matmul(h[s:e], model["low"][b].T, out=p[2, s:e])
    np.clip(p, -30, 30, out=p)
    np.exp(p, out=p)
    p /= (p.reshape(-1, BRANCH) @ np.ones(BRANCH, np.float32)).reshape(3, -1, 1)
    return h, p


def _digits(ids: np.ndarray) -> np.ndarray:
    return np.stack((ids >> 8, (ids >> 4) & 15, ids & 15))


def _in_order(spaced: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(order of the words by id >> 4, ids around them, their ids), the latter two in that order."""
    order = np.argsort(spaced[place] >> 4, kind="stable")
    place = place[order]
    return order, [spaced[place + k] for k in OFFSETS], spaced[place]


def log_probabilities(model: dict, spaced: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The log probability of each word at these places given the words on both its sides; the word itself is masked."""
    out = np.zeros(len(place))
    for at in range(0, len(place), BATCH):
        order, around, ids = _in_order(spaced, place[at : at + BATCH])
        _, p = _forward(model, around, ids)
        picked = p[np.arange(3)[:, None], np.arange(len(ids)), _digits(ids)]
        out[at + order] = np.log(picked, dtype=np.float64).sum(axis=0)
    return out


def gradients(model: dict, around: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, dict]:
    """(gradient of the summed negative log probability by the hidden units' inputs, row by row; by the tree's weights)."""
    h, p = _forward(model, around, ids)
    p[np.arange(3)[:, None], np.arange(len(ids)), _digits(ids)] -= 1
    of = {"top": p[0].T @ h, "middle": np.zeros(_SHAPES["middle"], np.float32), "low": np.zeros(_SHAPES["low"], np.float32)}
    back = p[0] @ model["top"]
    for a, s, e in _runs(ids >> 8):
        np.matmul(p[1, s:e].T, h[s:e], out=of["middle"][a])
        back[s:e] += p[1, s:e] @ model["middle"][a]
    for b, s, e in _runs(ids >> 4):
        np.matmul(p[2, s:e].T, h[s:e], out=of["low"][b])
        back[s:e] += p[2, s:e] @ model["low"][b]
    back *= 1 - h * h
    return back, of


def train_step(model: dict, spaced: np.ndarray, place: np.ndarray, rate: float = RATE) -> None:
    """One step of gradient descent on a batch, in place. A row's summed gradient is divided by the root of how many words sum up in it."""
    _, around, ids = _in_order(spaced, place)
    back, of = gradients(model, around, ids)
    hits = np.bincount(ids >> 4, minlength=BRANCH**2).astype(np.float32)
    model["top"] -= rate / np.sqrt(len(ids)) * of["top"]
    model["middle"] -= (rate / np.sqrt(np.maximum(hits.reshape(BRANCH, BRANCH).sum(1), 1)))[:, None, None] * of["middle"]
    model["low"] -= (rate / np.sqrt(np.maximum(hits, 1)))[:, None, None] * of["low"]
    for k, near in enumerate(around):
        order = np.argsort(near, kind="stable")
        near = near[order]
        starts = np.concatenate(([0], np.flatnonzero(near[1:] != near[:-1]) + 1))
        n = np.diff(starts, append=len(near)).astype(np.float32)
        model["side"][k][near[starts]] -= (rate / np.sqrt(n))[:, None] * np.add.reduceat(back[order], starts)


def _pack(model: dict) -> bytes:
    return b"".join(model[k].tobytes() for k in _SHAPES)


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    out, at, flat = {}, 0, np.frombuffer(raw, np.float32)
    for k, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).copy()
        at += n
    return out


def train(docs: DataFrame, vocabulary: list[int], counts: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of training in every task and averaging by the words each has seen. Without any text: the untrained model.

    Every word of every document is trained on once: a text's segments go to the rounds in turn, the first one's by a hash.
    Models are averaged in the order of their tasks, so the same partitions give the same model.
    """
    spark = docs.sparkSession
    state = _pack(new_model(counts))
    known = spark.sparkContext.broadcast(vocabulary)  # at most VOCABULARY names
    for turn in range(rounds):
        given = spark.sparkContext.broadcast(state)  # the model's fixed size

        def run(batches: Iterator[pa.RecordBatch], turn=turn, given=given) -> Iterator[pa.RecordBatch]:
            model, ids_of, seen = _unpack(given.value), Ids(known.value), 0
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    column = batch.column(0).slice(at, ROWS)
                    name, first = _named(column)
                    spaced, place = _spaced(ids_of(name), first)
                    turns = np.array([zlib.crc32(t.as_buffer()) for t in column], np.int64)
                    sizes = np.diff(first)
                    segment = (np.arange(len(place)) - np.repeat(first[:-1], sizes)) // SEGMENT + np.repeat(turns, sizes)
                    mine = place[segment % rounds == turn]
                    seen += len(mine)
                    for k in range(0, len(mine), BATCH):
                        train_step(model, spaced, mine[k : k + BATCH])
            if seen:
                yield pa.record_batch([pa.array([_task()]), pa.array([seen]), pa.array([_pack(model)], pa.binary())], ["task", "weight", "model"])

        partial = _lower(docs).mapInArrow(run, "task long, weight long, model binary")
        n = docs.rdd.getNumPartitions()
        while True:  # a tree of averages: no task takes in more than FAN_IN models
            n = -(-n // FAN_IN)
            partial = partial.groupBy((F.col("task") % n).alias("group")).applyInPandas(_average, "task long, weight long, model binary")
            if n == 1:
                break
        got = partial.first()
        state = bytes(got.model) if got else state
    return _unpack(state)


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _average(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    parts = parts.sort_values("task")
    total, weight = np.zeros(1), int(parts.weight.sum())
    for w, raw in zip(parts.weight, parts.model):
        total = total + np.frombuffer(raw, np.float32) * np.float64(w / weight)
    return pd.DataFrame({"task": [int(key[0])], "weight": [weight], "model": [np.asarray(total, np.float32).tobytes()]})


def rare_masses(counts: DataFrame, vocabulary: list[int]) -> np.ndarray:
    """The mass of each bucket: half a count is added to each of its words and to one unseen word, so that shares sum to 1."""
    known = counts.sparkSession.createDataFrame([(n,) for n in vocabulary], "name long")  # at most VOCABULARY names
    rare = counts.join(F.broadcast(known), "name", "left_anti").groupBy(F.pmod("name", F.lit(BUCKETS)).alias("bucket"))
    out = np.full(BUCKETS, 0.5)
    for r in rare.agg((F.sum("count") + 0.5 * (F.count("*") + 1)).alias("mass")).collect():  # BUCKETS rows
        out[r.bucket] = r.mass
    return out


def _rare_sums(rare: DataFrame, counts: DataFrame, masses: np.ndarray, rows_in_part: int) -> DataFrame:
    """(row, within): the summed log shares of each document's rare words (part, rows, names), by the counts of the same part.

    Occurrences and sums travel as arrays: first to the part of their names, then to that of their documents. No rare
    word is more frequent than the vocabulary's last, so no part is much larger than another.
    """

    def share(key: tuple, met: pa.Table, known: pa.Table) -> pa.Table:
        empty = pa.table({"range": pa.array([], pa.int64()), "rows": pa.array([], pa.list_(pa.int64())), "sums": pa.array([], pa.list_(pa.float64()))})
        if not met.num_rows:
            return empty
        name = np.concatenate([c.flatten().to_numpy() for c in met.column("names").chunks])
        row = np.concatenate([c.flatten().to_numpy() for c in met.column("rows").chunks])
        if not len(name):
            return empty
        have = known.column("name").to_numpy()
        order = np.argsort(have)
        have, n = have[order], known.column("count").to_numpy()[order]
        at = np.minimum(np.searchsorted(have, name), max(0, len(have) - 1))
        count = np.where(have[at] == name, n[at], 0) if len(have) else np.zeros(len(name))
        logs = np.log((count + 0.5) / masses[name % BUCKETS])
        row, which = np.unique(row, return_inverse=True)
        sums = np.bincount(which, logs, len(row))
        part = row // rows_in_part
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(row)]))
        return pa.table({"range": pa.array(part[cuts[:-1]]), "rows": _lists(row, cuts), "sums": _lists(sums, cuts)})

    def add(group: pa.Table) -> pa.Table:
        row = np.concatenate([c.flatten().to_numpy() for c in group.column("rows").chunks])
        logs = np.concatenate([c.flatten().to_numpy() for c in group.column("sums").chunks])
        order = np.lexsort((logs, row))  # one order of summing, whatever the order of arrival
        row, which = np.unique(row[order], return_inverse=True)
        return pa.table({"row": pa.array(row), "within": pa.array(np.bincount(which, logs[order], len(row)))})

    shared = rare.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(share, "range long, rows array<long>, sums array<double>")
    return shared.groupBy("range").applyInArrow(add, "row long, within double")


def score(docs: DataFrame, model: dict[str, np.ndarray], vocabulary: list[int], counts: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, log_likelihood (summed), mean_log_likelihood (null without a word).

    A rare word's share of its bucket comes from counts, those of count_words over the corpus; an unseen one has half a count.
    """
    spark = docs.sparkSession
    given, known = spark.sparkContext.broadcast(_pack(model)), spark.sparkContext.broadcast(vocabulary)
    parts = 1 + (counts.agg(F.max("part")).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, ids_of = _unpack(given.value), Ids(known.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                name, first = _named(part.column(2))
                ids = ids_of(name)
                logs = log_probabilities(net, *_spaced(ids, first))
                sums = np.diff(np.concatenate(([0.0], np.cumsum(logs)))[first])
                sizes = np.diff(first)
                rare = np.flatnonzero(ids >= VOCABULARY - BUCKETS)
                order, bounds = _dealt(name[rare], parts)
                rare = rare[order]
                rows = np.repeat(part.column(0).to_numpy(), sizes)[rare]
                none = lambda kind, n: pa.nulls(n, kind)
                columns = [part.column(0), part.column(1), pa.array(sizes), pa.array(sums), none(pa.int32(), len(sizes)), none(pa.list_(pa.int64()), len(sizes)), none(pa.list_(pa.int64()), len(sizes))]
                yield pa.record_batch(columns, columns_of)
                held = np.flatnonzero(np.diff(bounds)).astype(np.int32)
                lists = [_lists(x, bounds).take(pa.array(held)) for x in (rows, name[rare].view(np.int64))]
                columns = [none(pa.int64(), len(held)), none(pa.int64(), len(held)), none(pa.int64(), len(held)), none(pa.float64(), len(held)), pa.array(held), *lists]
                yield pa.record_batch(columns, columns_of)

    columns_of = ["row", "doc_id", "n_words", "known", "part", "rows", "names"]
    numbered = _lower(docs, F.monotonically_increasing_id().alias("row"), "doc_id")
    path = shared_dir(spark)
    found = saved(numbered.mapInArrow(run, "row long, doc_id long, n_words long, known double, part int, rows array<long>, names array<long>"), path)
    within = saved(_rare_sums(found.where("part is not null").select("part", "rows", "names"), counts, rare_masses(counts, vocabulary), 1 << 14))
    rows = found.where("part is null").select("row", "doc_id", "n_words", "known").join(within, "row", "left")
    whole = F.col("known") + F.coalesce("within", F.lit(0.0))
    done = saved(rows.select("doc_id", "n_words", whole.alias("log_likelihood"), F.when(F.col("n_words") > 0, whole / F.col("n_words")).alias("mean_log_likelihood")))
    drop_path(spark, path)
    return done


def score_corpus(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Count, train and score. Null and empty texts have no words: log_likelihood 0, mean null. Null and repeated doc_ids
    are scored row by row; an empty table gives no row. Other columns are not read."""
    counts = count_words(docs)
    vocabulary, of_id = count_vocabulary(counts)
    return score(docs, train(docs, vocabulary, of_id, rounds), vocabulary, counts)


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))
