"""Toxicity by compression distance: how much shorter windows of a text get with a dictionary of toxic text.

Two zstandard dictionaries are trained by zstandard's own trainer, one on ordinary text and one on the toxic passages of toxic
documents. Whole toxic documents don't do: they are ordinary prose but for a word or two, and dictionaries of theirs tell
them apart barely (README). The second compressor holds the first's dictionary too, so that windows without
anything toxic come out equally long and noise cancels. A logistic curve, fitted on other labelled rows, turns a
document's window differences into a score; the threshold is a score of it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import saved, table, text_of, with_ids

#: Bytes of a window of text, and of its overlap with the next.
WINDOW, OVERLAP = 56, 12
#: Bytes of the pieces told apart, which is also the shortest match.
GRAM = 6
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 8_192
#: Labelled rows of each label that fit the dictionaries, and as many that fit the curve, at most: a hash-chosen part of them.
FIT_ROWS = 20_000
#: Words of the labelled sample that reach the driver: toxic candidates, and the ordinary vocabulary by frequency.
CANDIDATES, VOCABULARY = 5_000, 100_000
#: Ordinary words that the ordinary dictionary is trained on, and samples of one word at most.
TRAINED_WORDS, SAMPLES_OF_WORD = 20_000, 20
THRESHOLD = 0.7
#: Stands before every window and in both dictionaries, so that zstd never falls back to storing a window raw.
PRIMER = b"<|w1nd0w:0f:t3xt|>"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def normalized(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()) + b" "


def _grams(piece: bytes) -> list[bytes]:
    return [piece[i : i + GRAM] for i in range(len(piece) - GRAM + 1)]


def train_dictionaries(toxic_words: dict[str, int], ordinary_words: dict[str, int], toxic_docs: list[list[str]], cover: int = 2, least: int = 3) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents, from word counts by document and the candidate words of toxic documents.

    Both are trained by zstandard. Toxic pieces are the stretches of candidate words that hold
    no gram of the ordinary vocabulary. Of their grams, a greedy cover takes those that explain most
    documents, until each is explained `cover` times or fewer than `least` are left: words that merely go along in
    copies of one document explain nothing further. A document's pieces that hold a chosen gram are its passages, and
    the passages of all toxic documents are what the toxic dictionary is trained on.
    """
    samples = [b" " + w.encode() for w, n in sorted(ordinary_words.items(), key=lambda x: (-x[1], x[0]))[:TRAINED_WORDS] for _ in range(min(n, SAMPLES_OF_WORD))]
    ordinary = _trained(samples, ORDINARY_BYTES)
    usual = {g for w in ordinary_words for g in _grams(b" " + w.encode() + b" ")}

    def pieces(word: str) -> list[bytes]:
        padded, out = b" " + word.encode() + b" ", []
        for i, g in enumerate(_grams(padded)):
            if g not in usual:
                if out and out[-1][1] == i + GRAM - 1:
                    out[-1][1] = i + GRAM
                else:
                    out.append([i, i + GRAM])
        return [padded[a:b] for a, b in out]

    of_word = {w: pieces(w) for w in toxic_words}
    counts: Counter[bytes] = Counter()
    for w, n in toxic_words.items():
        for p in of_word[w]:
            counts[p] += n
    holders: defaultdict[bytes, set[int]] = defaultdict(set)
    for k, words in enumerate(toxic_docs):
        for w in words:
            for p in of_word.get(w, ()):
                for g in _grams(p):
                    holders[g].add(k)
    need, chosen = Counter({k: cover for k in range(len(toxic_docs))}), set()
    while holders:
        best = max(holders, key=lambda g: (sum(need[k] > 0 for k in holders[g]), len(holders[g]), g))
        explained = holders.pop(best)
        if sum(need[k] > 0 for k in explained) < least:
            break
        chosen.add(best)
        for g in [g for g, ks in holders.items() if ks == explained or (g[1:] == best[:-1] or g[:-1] == best[1:])]:
            holders[g] = holders[g] - explained  # the next gram of the same word explains these no second time
        for k in explained:
            need[k] -= 1
    kept = {p for p in counts if any(g in chosen for g in _grams(p))}
    passages = [b"".join(p for w in words for p in of_word.get(w, ()) if p in kept) for words in toxic_docs]
    return ordinary, _trained([p for p in passages if p], TOXIC_BYTES)


def _trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of samples; of too few to train on, their distinct texts, common ones last."""
    try:
        return zstandard.train_dictionary(size, samples, d=GRAM, k=64).as_bytes()
    except (zstandard.ZstdError, ValueError):
        counts = Counter(samples)
        return b"".join(sorted(counts, key=lambda x: (counts[x], x)))[-size:]


def _compressor(content: bytes):
    how = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=16, hash_log=15, chain_log=15, search_log=3, min_match=GRAM, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    trained = zstandard.ZstdCompressionDict(content + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=how).compress


def window_features(docs: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """(doc_id, windows, best, strong): windows of the whole text, the largest gain of the toxic dictionary, windows that gain 3 bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, other = _compressor(ordinary), _compressor(toxic + ordinary)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text, n, best, strong = normalized(value.as_py()), 0, 0, 0
                for k in range(0, max(1, len(text) - OVERLAP), WINDOW - OVERLAP):
                    window = PRIMER + text[k : k + WINDOW]
                    gain = len(plain(window)) - len(other(window))
                    n, best, strong = n + 1, max(best, gain), strong + (gain >= 3)
                rows.append((n, best, strong))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.record_batch([batch.column(0), *map(pa.array, columns)], ["doc_id", "windows", "best", "strong"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, windows long, best long, strong long")


def _inputs(windows, best, strong, log) -> list:
    return [best * 1.0, log(strong + 1.0), log(windows + 1.0)]


def fit_curve(rows: list, steps: int = 40, ridge: float = 1e-2) -> list[float]:
    """Weights of a logistic curve over (windows, best, strong, toxic, weight) rows, the constant last; by Newton's steps.

    A row counts as often as its weight says: the labelled rows that it stands for.
    """
    x = np.array([[*_inputs(r[0], r[1], r[2], math.log), 1.0] for r in rows])
    y = np.array([float(r[3]) for r in rows])
    n = np.array([float(r[4]) for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
    return w.tolist()


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _sample(labels: DataFrame, part: int) -> DataFrame:
    """(doc_id, toxic, weight) of a fold: each label's rows, or a hash-chosen part of about FIT_ROWS; weight is how many rows of its label a row stands for."""
    rows = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) == part).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    share = F.lit(1.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, FIT_ROWS / n))).otherwise(share)
    kept = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return kept.withColumn("weight", 1 / share)


def learn_dictionaries(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes]:
    """From the labelled rows whose crc32(doc_id) mod 3 is 0; see train_dictionaries."""
    sample = saved(_sample(labels, 0))
    texts = with_ids(docs.select("doc_id", "text"), sample.select("doc_id")).join(sample, "doc_id")
    lower = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = saved(texts.select("doc_id", "toxic", F.explode(F.array_distinct(F.split(lower, r"[\x20\x09-\x0D]+"))).alias("word")).where("word <> ''").distinct())  # a doc_id that is repeated counts once
    toxic, size = F.col("toxic") == 1, sample.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("t")).first()
    if not 0 < size.t < size.n:
        return b"", b""
    counts = saved(words.groupBy("word").agg(F.count_if(toxic).alias("t"), F.count_if(~toxic).alias("o")))
    kinds = counts.where("t > 0").count()
    # so rare by chance among ordinary documents that less than one of so many words would be; by the rows counted, cut or not
    least = math.ceil(math.log(max(2, kinds)) / math.log(size.n / size.t)) + 1
    found = counts.where((F.col("o") == 0) & (F.col("t") >= least)).orderBy(F.desc("t"), "word").limit(CANDIDATES)
    candidates = {r.word: r.t for r in found.collect()}
    usual = {r.word: r.o for r in counts.where("o >= 2").orderBy(F.desc("o"), "word").limit(VOCABULARY).collect()}
    held = words.where(toxic).join(F.broadcast(found.select("word")), "word").groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    return train_dictionaries(candidates, usual, [sorted(r.words) for r in held.orderBy("doc_id").collect()])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score (0 to 1), predicted.

    Scores come from the text alone. Null and empty texts are one window without gain. Rows with a null doc_id are
    scored, not held out, and never learned from. Where labels hold one class only or none, the score is the
    share of toxic labels among those learned from, 0 without any.
    """
    ordinary, toxic = learn_dictionaries(docs, labels)
    features = saved(window_features(docs, ordinary, toxic))
    sample = saved(_sample(labels, 2))
    # one row for each labelled doc_id, the most toxic one of repeated ids, so that no more than the sample's bound comes to the driver
    fitted = features.join(sample, "doc_id").groupBy("doc_id", "toxic", "weight").agg(F.max(F.struct("best", "strong", "windows")).alias("f"))
    rows = [(r.f.windows, r.f.best, r.f.strong, r.toxic, r.weight) for r in fitted.orderBy("doc_id").collect()]
    if toxic and 0 < sum(r[3] for r in rows) < len(rows):
        weights = fit_curve(rows)
        logit = F.lit(weights[-1])
        for w, x in zip(weights, _inputs(F.col("windows"), F.col("best"), F.col("strong"), F.log)):
            logit = logit + F.lit(w) * x
        score = 1 / (1 + F.exp(-logit))
    else:
        score = F.lit(sum(r[3] * r[4] for r in rows) / sum(r[4] for r in rows) if rows else 0.0)
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return features.select("doc_id", held_out.alias("held_out"), score.cast("double").alias("score"), *["windows", "best", "strong"]).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
