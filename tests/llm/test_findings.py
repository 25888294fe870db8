"""Tests of what the first review found missing."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lapwing.llm import common, decontamination, near_copies, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def brute_groups(texts: list[str | None]) -> list[int]:
    sets = []
    for text in texts:
        w = (text or "").lower().split()
        k = min(5, len(w))
        sets.append({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def edited(rng, words: list[str], n: int) -> str:
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_stage_drops_all_near_copies_of_similarity_0_8(spark, sf_dir, monkeypatch):
    rng = random.Random(11)
    texts = [None, "", " \n", "one", "ONE", "a b c"]
    for size in (40, 120, 300):
        for base in ([f"w{rng.randrange(5000)}" for _ in range(size)] for _ in range(6)):
            texts += [" ".join(base), *(edited(rng, base, rng.randrange(1, size // 25 + 1)) for _ in range(6))]
    texts += [edited(rng, [f"v{k}" for k in range(100)], 2) for _ in range(40)]  # a large bucket
    groups = brute_groups(texts)
    docs = common.saved(frame(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)]).repartition(3))
    for bucket in (2, 24):
        monkeypatch.setattr(near_copies, "PAIR_BUCKET", bucket)
        kept = corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))


def test_cut_labels_keep_their_prior(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 40)
    docs = frame(spark, [(k, "plain words of every day", "en", "a", 1) for k in range(3000)])
    labels = frame(spark, [(k, 1, int(k % 10 == 0)) for k in range(3000)], "doc_id long, quality int, toxic int")
    weights = {r.toxic: r.w for r in toxicity._sample(labels, 2).groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    score = toxicity.toxicity(docs, labels).first().score
    assert abs(score - weights[1] / sum(weights.values())) < 1e-9 and 0.05 < score < 0.2


def test_curve_of_cut_rows_is_that_of_all():
    rng = random.Random(4)
    rows = []
    for _ in range(30_000):
        toxic = rng.random() < 0.1
        strong = sum(rng.random() < (0.3 if toxic else 0.1) for _ in range(5))
        rows.append((20, 2 * strong, strong, int(toxic), 1.0))
    cut = [r[:4] + (1.0 if r[3] else 10.0,) for r in rows if r[3] or rng.random() < 0.1]
    score = lambda w, r: 1 / (1 + np.exp(-np.dot(w, [*toxicity._inputs(*r[:3], np.log), 1.0])))
    whole, part = toxicity.fit_curve(rows), toxicity.fit_curve(cut)
    assert all(abs(score(whole, (20, 2 * s, s)) - score(part, (20, 2 * s, s))) < 0.05 for s in range(4))


def test_stages_tell_rows_of_null_and_repeated_ids_apart(spark, sf_dir):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, a), (None, "x " + c)]
    docs = frame(spark, [(i, t, "en", "a", 1) for i, t in rows])
    for groups in (None, near_copies.similar_groups(docs)):
        kept = simhash.drop_near_duplicates(docs, groups)
        wanted = {(1, a): 1, (2, b): 1, (3, c): 1, (None, d): 1}
        found = Counter((r.doc_id, r.text) for r in kept.collect())
        assert all(found[k] == n for k, n in wanted.items()) and found[2, a] == found[None, a] == 0
        assert groups is None or found == Counter(wanted)
    clean = decontamination.drop_leaks(docs, frame(spark, [(1, a)], "item_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for x in rows if x[1] != a)


def test_variants_without_their_original_meet_only_where_they_can(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = [edited(rng, base, rng.choice((1, 1, 2, 4, 6))) for _ in range(90)] + [" ".join(f"u{rng.randrange(9999)}" for _ in range(60)) for _ in range(5)]
    docs = common.saved(frame(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)]))
    sets = [near_copies.shingle_set(t) for t in texts]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    held = spark.createDataFrame([(k, [int(x) for x in s.view(np.int64)]) for k, s in enumerate(sets)], "cls long, shingles array<long>")
    rows = {r.cls: r for r in near_copies._linkable(held, 0.8).collect()}
    assert near and {k for pair in near for k in pair} <= set(rows) and len(rows) < 90
    for i, j in near:
        apart = sum(((rows[i][f"parity{w}"] ^ rows[j][f"parity{w}"]) & (2**64 - 1)).bit_count() for w in range(near_copies.WORDS))
        assert apart <= len(np.setxor1d(sets[i], sets[j])) and rows[i].n == len(sets[i]) >= rows[i].shared
    monkeypatch.setattr(near_copies, "PAIR_BUCKET", 2)
    found = {r.doc_id: r.component_id for r in near_copies.similar_groups(docs).collect()}
    assert [found[k] for k in range(len(texts))] == brute_groups(texts)


def test_rules_do_not_depend_on_the_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    of = common.saved(docs.select("doc_id", quality.text_statistics(common.text_of()).alias("of")))
    rows = common.saved(quality._labelled(of, labels))
    found = [quality.learn_rules(rows.repartition(n)) for n in (1, 7, 31)]
    assert found[0] == found[1] == found[2]
    values = spark.createDataFrame([(0.0,), (0.00123456,), (1234567.0,), (7.0,)], "x double").select(quality._significant(F.col("x"))).collect()
    np.testing.assert_allclose([r[0] for r in values], [0, 0.00123, 1230000, 7])
