"""The pipeline's second stage goes by SimHash: fingerprints, blocks, Hamming distance, then exact similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lapwing.llm import near_copies


def sets(rng, n, m, both):
    names = rng.integers(0, 2**64, n + m - both, np.uint64)
    return names[:n], np.concatenate((names[:both], names[n:]))


def test_fingerprint_is_the_majority_of_hash_bits():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 255, 256, 700):
        names = rng.integers(0, 2**64, n, np.uint64)
        one = np.array([np.unpackbits(near_copies.fingerprint(names[k : k + 1]), bitorder="little") for k in range(n)], np.int64)
        assert (np.unpackbits(near_copies.fingerprint(names), bitorder="little") == (2 * one.sum(axis=0) > n)).all()
        assert n < 255 or abs(one.mean() - 0.5) < 0.01


def test_pairs_at_the_threshold_share_blocks_and_pass_the_distance():
    rng, size = np.random.default_rng(2), 2 * near_copies.BLOCKS
    for n, m, both in ((6, 5, 5), (9, 9, 8), (15, 12, 12), (90, 90, 80), (400, 320, 320)):
        for _ in range(60):
            a, b = (near_copies.fingerprint(s) for s in sets(rng, n, m, both))
            assert (a[:size].view("<u2") == b[:size].view("<u2")).any()
            assert np.unpackbits(a[size:] ^ b[size:]).sum() <= near_copies.APART
    for _ in range(60):
        a, b = sets(rng, 5, 4, 4)
        assert set(near_copies._fifths(b)) < set(near_copies._fifths(a)) and len(near_copies._fifths(a)) == 5


def test_a_bucket_with_many_near_members_stays_open():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 2, np.uint64)
    bits = np.concatenate((np.repeat(base[None], 30, axis=0), rng.integers(0, 2**64, (40, 2), np.uint64)))
    block = np.concatenate((np.full(50, 7, np.uint16), np.full(20, 9, np.uint16)))
    cls = np.arange(70, dtype=np.int64)
    half = [pa.table({"part": pa.array([0], pa.int32()), **{k: pa.array([x[at].tobytes()], pa.binary()) for k, x in (("cls", cls), ("block", block), ("bits", bits))}}) for at in (slice(0, 35), slice(35, 70))]
    few = near_copies._near_in_part(pa.concat_tables(half), 1, 30).to_pylist()
    assert {frozenset((r["a"], r["b"])) for r in few} == {frozenset((i, j)) for i in range(30) for j in range(i)} and all(r["key"] is None for r in few)
    many = near_copies._near_in_part(pa.concat_tables(half), 1, 3).to_pylist()
    links = [r for r in many if r["b"] is not None]
    assert len(links) == 29 and {x for r in links for x in (r["a"], r["b"])} == set(range(30))
    assert sorted(r["a"] for r in many if r["b"] is None) == list(range(50)) and {r["key"] for r in many if r["b"] is None} == {7}


def test_short_texts_of_four_and_five_shingles_meet(spark):
    texts = [" ".join(f"{x}{k}" for k in range(n)) for x in "abcdefghij" for n in (9, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.similar_groups(docs).collect()}
    assert found == {k: k - k % 2 for k in range(20)}


def test_variants_that_are_not_similar_are_not_verified(spark, monkeypatch):
    rng, verified, seen = np.random.default_rng(4), near_copies._verified, []

    def counted(pairs, *more):
        seen.append(len({frozenset(r) for r in pairs.select("a", "b").collect()}))
        return verified(pairs, *more)

    monkeypatch.setattr(near_copies, "_verified", counted)
    texts = []
    for k in range(60):  # three words of their own each: similarity about 0.68 with all others
        words = [f"w{i}" for i in range(150)]
        for at in rng.choice(range(5, 145), 3, replace=False):
            words[at] = f"own{k}-{at}"
        texts.append(" ".join(words))
    texts += [f"{texts[k]} end" for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.similar_groups(docs).collect()}
    held = [near_copies.shingle_set(t) for t in texts]
    near = {(i, j) for i in range(len(held)) for j in range(i) if 5 * len(np.intersect1d(held[i], held[j])) >= 4 * len(np.union1d(held[i], held[j]))}
    low = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    assert found == dict(enumerate(low)) and sum(seen) <= len(texts) + len(near)


def test_rounds_try_pairs_of_different_components_only():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 2**64, 90, np.uint64)
    held = [names] * 40 + [np.concatenate((names[:60], rng.integers(0, 2**64, 30, np.uint64)))]
    parity, n = near_copies._parity_words(held), np.full(41, 90, np.int32)
    fields = {"cls": np.arange(41), "block": np.full(41, 3, np.uint16), "bits": np.zeros((41, 2), np.uint64), "component": np.array([7] * 30 + [8] * 10 + [9]), "n": n, "parity": parity}
    group = pa.table({"part": pa.array([0], pa.int32()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in fields.items()}})
    pairs = near_copies._near_in_part(group, 1, 30, 0.8).to_pylist()
    assert {frozenset((r["a"], r["b"])) for r in pairs} == {frozenset((i, j)) for i in range(30) for j in range(30, 40)}
    open_ = near_copies._near_in_part(group, 1, 3, 0.8).to_pylist()
    assert len([r for r in open_ if r["b"] is not None]) == 30 and sorted(r["a"] for r in open_ if r["b"] is None) == list(range(41))
    few = near_copies._few_in_part(group.select(["part", "cls", "block", "bits"]), 1, 1).to_pylist()
    assert {r["a"] for r in few if r["b"] is None} == set(range(41)) and all(r["key"] == 3 for r in few if r["b"] is None)
