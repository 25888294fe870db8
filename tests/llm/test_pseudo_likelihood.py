"""The masked network and its scores against plain Python."""

from __future__ import annotations

import math
import random
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lapwing.llm import pseudo_likelihood as lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", 1) for k, t in texts], SCHEMA)


def filled(seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    return {k: (rng.standard_normal(shape) * 0.3).astype(np.float32) for k, shape in lm._SHAPES.items()}


def brute_log(model: dict, around: list[int], word: int) -> float:
    h = np.tanh(sum(model["side"][k][w].astype(float) for k, w in enumerate(around)))
    h[-1] = 1
    total = 0.0
    for weights, digit in ((model["top"], word >> 8), (model["middle"][word >> 8], (word >> 4) & 15), (model["low"][word >> 4], word & 15)):
        logits = weights.astype(float) @ h
        total += logits[digit] - math.log(np.exp(logits).sum())
    return total


def test_probabilities_of_all_words_sum_to_one():
    model = filled()
    spaced = np.concatenate([[5, 9, w, 11, 4000] for w in range(lm.VOCABULARY)]).astype(np.int16)
    logs = lm.log_probabilities(model, np.concatenate((np.zeros(2, np.int16), spaced, np.zeros(2, np.int16))), np.arange(lm.VOCABULARY) * 5 + 4)
    assert abs(np.exp(logs).sum() - 1) < 1e-4
    for w in (0, 1, 77, 4095):
        assert abs(logs[w] - brute_log(model, [5, 9, 11, 4000], w)) < 1e-4


def test_gradients_are_differences():
    model, rng = filled(), np.random.default_rng(1)
    spaced, place = lm._spaced(rng.integers(1, 60, 300).astype(np.int16), np.array([0, 120, 300]))
    loss = lambda m: -lm.log_probabilities(m, spaced, place).sum()
    _, around, ids = lm._in_order(spaced, place)
    back, of = lm.gradients(model, around, ids)
    for name, at in (("top", (0, 3)), ("middle", (0, 2, 5)), ("low", (1, 4, 15)), ("low", (2, 0, 1))):
        moved = {k: v.astype(np.float64) for k, v in model.items()}
        moved[name][at] += 1e-2
        lower = {k: v.astype(np.float64) for k, v in model.items()}
        lower[name][at] -= 1e-2
        assert abs((loss(moved) - loss(lower)) / 2e-2 - of[name][at]) < 0.02 * (1 + abs(of[name][at]))
    for word, unit in ((7, 2), (33, 14)):
        moved, lower = ({k: v.astype(np.float64) for k, v in model.items()} for _ in range(2))
        moved["side"][1][word, unit] += 1e-2
        lower["side"][1][word, unit] -= 1e-2
        mine = back[around[1] == word, unit].sum()
        assert abs((loss(moved) - loss(lower)) / 2e-2 - mine) < 0.02 * (1 + abs(mine))


def test_a_step_lowers_the_loss():
    ids = np.random.default_rng(0).integers(1, 50, 400).astype(np.int16)
    spaced, place = lm._spaced(ids, np.array([0, 400]))
    model = lm.new_model()
    before = lm.log_probabilities(model, spaced, place).sum()
    for _ in range(5):
        lm.train_step(model, spaced, place)
    assert lm.log_probabilities(model, spaced, place).sum() > before


def test_every_word_is_trained_on_once(spark, monkeypatch):
    texts = ["one", "two words", " ".join(f"w{k}" for k in range(300)), " ".join(f"v{k}" for k in range(70)), "", None] + ["a b c"] * 5
    docs = frame(spark, list(enumerate(texts))).coalesce(1)
    vocabulary, counts = lm.count_vocabulary(lm.count_words(docs))
    path = tempfile.mkdtemp(prefix="spark-")

    def note(model, spaced, place, rate=0.0):
        with open(f"{path}/ids", "a") as f:
            f.writelines(f"{i}\n" for i in spaced[place])

    monkeypatch.setattr(lm, "train_step", note)
    cloudpickle.register_pickle_by_value(lm)  # tasks take the noting version
    try:
        lm.train(docs, vocabulary, counts)
    finally:
        cloudpickle.unregister_pickle_by_value(lm)
    words = Counter(w for t in texts for w in (t or "").split())
    name = dict(zip(lm.word_names(list(words)), words))
    with open(f"{path}/ids") as f:
        assert Counter(name[vocabulary[int(i) - 1]] for i in f) == words


@pytest.mark.parametrize("rows", [256, 3])
def test_scores_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(lm, "ROWS", rows)
    rng = random.Random(5)
    many = [f"x{k}" for k in range(5000)]  # more words than ids
    texts = [(k, " ".join(rng.choice(many) if rng.random() < 0.3 else rng.choice("pqrstuv") for _ in range(rng.randrange(1, 90)))) for k in range(150)]
    texts += [(None, None), (500, ""), (501, " \n"), (502, "Once\tpé p"), (3, texts[3][1]), (503, "w " * 40_000), (504, " ".join(many))]
    docs = frame(spark, texts).repartition(3)
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("row", "name", "part", "count", "known", "rows")])
    counts = lm.count_words(docs)
    true = Counter(w for _, t in texts for w in (t or "").lower().split())
    assert {r.name: r["count"] for r in counts.collect()} == dict(zip(lm.word_names(list(true)), true.values()))
    vocabulary, of_id = lm.count_vocabulary(counts)
    assert of_id.sum() == sum(true.values()) and len(vocabulary) == min(len(true), lm.VOCABULARY - lm.BUCKETS - 1)
    model = filled()
    at = {n: k + 1 for k, n in enumerate(vocabulary)}
    name = dict(zip(true, lm.word_names(list(true))))
    bucket = Counter()
    for w, n in true.items():
        if name[w] not in at:
            bucket[name[w] % lm.BUCKETS] += n + 0.5
    expected = []
    for doc_id, t in texts:
        words = (t or "").lower().split()[:]
        ids = [at.get(name[w], lm.VOCABULARY - lm.BUCKETS + name[w] % lm.BUCKETS) for w in words]
        padded = [0, 0, *ids, 0, 0]
        known: dict = {}
        total = 0.0
        for i, (w, x) in enumerate(zip(words, ids)):
            around = (padded[i], padded[i + 1], padded[i + 3], padded[i + 4])
            if (around, x) not in known:
                known[around, x] = brute_log(model, list(around), x)
            total += known[around, x]
            if name[w] not in at:
                total += math.log((true[w] + 0.5) / (bucket[name[w] % lm.BUCKETS] + 0.5))
        expected.append((doc_id if doc_id is not None else -1, len(words), total))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.log_likelihood) for r in lm.score(clash, model, vocabulary, counts).collect())
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expected)]
    assert all(abs(g[2] - e[2]) < 1e-4 * (1 + g[1]) for g, e in zip(got, sorted(expected)))


def test_training_helps_and_reruns_agree(spark):
    rng = random.Random(5)
    docs = frame(spark, [(k, " ".join(f"{a} {a}y {a}z" for a in rng.choices("pqrstuv", k=60))) for k in range(150)] + [(None, None), (500, "")]).repartition(2).cache()
    counts = lm.count_words(docs)
    vocabulary, of_id = lm.count_vocabulary(counts)
    model = lm.train(docs, vocabulary, of_id, rounds=4)
    again = lm.train(docs, vocabulary, of_id, rounds=4)
    assert all((model[k] == again[k]).all() for k in model)
    mean = lambda m: {r.doc_id: r.mean_log_likelihood for r in lm.score(docs, m, vocabulary, counts).collect()}
    trained, plain = mean(model), mean(lm.new_model(of_id))
    assert trained[500] is None and trained[None] is None
    assert np.mean([trained[k] for k in range(150)]) > np.mean([plain[k] for k in range(150)])


def test_nothing(spark):
    assert lm.score_corpus(frame(spark, [])).count() == 0
