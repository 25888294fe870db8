"""Each training-data operator against a brute-force version, with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lapwing.llm import common, compaction, decontamination, line_dedup, mixing, pseudo_likelihood, quality, simhash, simple8b, suffix_dedup, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def awkward(seed: int = 1) -> list[tuple]:
    """Documents with every awkward case: copies, near copies, null and empty fields, one long text, repeated rows."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(80)] + ["Ünï", "don't", "x,", "THE"]
    base = [[rng.choice(words) for _ in range(rng.randrange(25, 60))] for _ in range(8)]
    rows = []
    for k in range(60):
        text = list(rng.choice(base))
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = rng.choice(words)
        cut = rng.randrange(len(text))
        rows.append((k, " ".join(text[:cut]) + "\n" + " ".join(text[cut:]), "en", rng.choice(["a", "b", "ç", None]), 1))
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t ", "en", "b", 4), (103, "one", "en", "b", 3), (104, "one", "en", "b", 3)]
    rows += [(None, rows[3][1], "en", "a", 2), (105, "z" * 900, "en", "a", 900), (106, "long " * 4000, "en", None, 20000), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return common.saved(frame(spark, awkward()).repartition(3))


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return frame(spark, [(k, k % 3 > 0, k % 4 == 0) for k in range(60)], "doc_id long, quality boolean, toxic boolean").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))


def test_empty_tables(spark, nothing):
    no_labels = frame(spark, [], "doc_id long, quality int, toxic int")
    items = frame(spark, [], "item_id long, text string")
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert mixing.plan_mix(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert suffix_dedup.dedup_strings(nothing).count() == 0
    assert simhash.simhash_groups(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0
    assert quality.judge(nothing, no_labels).count() == 0 and quality.drop_poor(nothing, no_labels).count() == 0
    assert toxicity.toxicity(nothing, no_labels).count() == 0
    assert pseudo_likelihood.score_corpus(nothing).count() == 0
    assert decontamination.leaks(nothing, items).count() == 0


def test_extra_columns_with_clashing_names(docs):
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("fp", "component_id", "th", "s1", "copy", "position", "of", "kept", "words", "hash", "size", "text_id")])
    for f in (simhash.drop_near_duplicates, mixing.mix):
        assert f(clash).columns == clash.columns
    assert line_dedup.dedup_lines(clash).count() == clash.count() == suffix_dedup.dedup_strings(clash).count()
    assert simhash.simhash_groups(clash).count() == clash.count()


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 3), (7, 8), (8, 7), (3, 10), (20, 10)]
    got = {r.node: r.component for r in common.components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 20: 1, 4: 4, 5: 4, 7: 7, 8: 7}
    chain = frame(spark, [(k, k + 1) for k in range(300)], "a long, b long")
    assert {r.component for r in common.components(chain).collect()} == {0}


# lines


def brute_lines(rows):
    lower = {k: k + 32 for k in range(65, 91)}
    kinds = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = [], {}
    for doc_id, text in kinds:
        lines, kept = text.split("\n"), []
        for line in lines:
            words = frozenset(line.translate(lower).encode().split())
            if not words or not any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[doc_id, text] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return Counter((r[0], *out[r[0], r[1] or ""]) for r in rows)


def test_line_dedup(docs):
    assert Counter(map(tuple, line_dedup.dedup_lines(docs).collect())) == brute_lines(awkward())


@pytest.mark.parametrize("variants", [100, 300])
def test_lines_with_one_match_among_many_variants(spark, variants):
    """A document each: a line, variants of it by one word, and a line whose only earlier match is the first one, though it shares keys with all."""
    rows = []
    for d in range(8):
        base = [f"d{d}w{k}" for k in range(20)]
        lines = [" ".join(base)] + [" ".join(base[:k % 18] + [f"d{d}v{k}"] + base[k % 18 + 1 :]) for k in range(variants)]
        rows.append((d, "\n".join([*lines, " ".join(base[:18] + [f"d{d}x", f"d{d}y"])]), "en", "a", 1))
    got = Counter(map(tuple, line_dedup.dedup_lines(frame(spark, rows)).collect()))
    assert got == brute_lines(rows)


def test_lines_whose_rows_are_out_of_order(spark):
    base = [f"w{k}" for k in range(20)]
    rows = [(1000, " ".join(base)), (1, " ".join(base))] + [(k, " ".join(base[: k % 18] + [f"v{k}"] + base[k % 18 + 1 :])) for k in range(10, 110)]
    rows += [(700, " ".join(base[:18] + ["x", "y"])), (2**40, " ".join(base)), (-5, " ".join(base[:17] + ["p", "q", "r"])), (None, " ".join(base[:16] + ["s"]))]
    rows = [(*r, "en", "a", 1) for r in rows]
    for seed in (None, 1, 2):
        if seed:
            random.Random(seed).shuffle(rows)
        got = Counter(map(tuple, line_dedup.dedup_lines(frame(spark, rows).coalesce(1)).collect()))
        assert got == brute_lines(rows)


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_random_variants_with_few_hubs(spark, monkeypatch, seed):
    """Groups whose members match in part only, far more than are tried, in any order of rows."""
    monkeypatch.setattr(line_dedup, "HUBS", 2)
    monkeypatch.setattr(line_dedup, "TRIED", 5)
    rng = random.Random(seed)
    rows = []
    for d in range(250):
        base = [f"g{d % 3}w{k}" for k in range(24)]
        for _ in range(rng.randrange(0, 7)):
            base[rng.randrange(24)] = f"r{rng.randrange(40)}"
        rows.append((rng.randrange(10**6), " ".join(base[: rng.randrange(18, 25)]), "en", "a", 1))
    got = Counter(map(tuple, line_dedup.dedup_lines(frame(spark, rows).repartition(3)).collect()))
    assert got == brute_lines(rows)


def test_prefixes_hold_a_common_key():
    rng = random.Random(4)
    for _ in range(3000):
        pool = [rng.getrandbits(64) for _ in range(60)]
        rank = {w: rng.choice((1, 2, 20, 30)) for w in pool}
        x = set(rng.sample(pool, rng.randrange(3, 40)))
        y = (x - set(rng.sample(sorted(x), rng.randrange(0, 1 + len(x) // 5)))) | set(rng.sample(pool, rng.randrange(0, 1 + len(x) // 5)))
        if x != y and 5 * len(x & y) >= 4 * len(x | y):
            keys = []
            for z in (x, y):
                ordered = sorted(z, key=lambda w: (rank[w], w))
                keys.append(set(line_dedup.prefix_keys(np.array(ordered, np.uint64), np.array([rank[w] for w in ordered], np.uint8), np.array([len(z)]))[0].tolist()))
            assert keys[0] & keys[1]


def test_near_sets_have_a_signature_in_common():
    rng = random.Random(6)
    for _ in range(2000):
        pool = [rng.getrandbits(64) for _ in range(70)]
        x = set(rng.sample(pool, rng.randrange(1, 60)))
        y = (x - set(rng.sample(sorted(x), rng.randrange(0, 1 + len(x) // 5)))) | set(rng.sample(pool, rng.randrange(0, 1 + len(x) // 5)))
        if y and 5 * len(x & y) >= 4 * len(x | y):
            sig = [set(line_dedup.signatures(np.array(sorted(z), np.uint64), np.array([len(z)]))[0].tolist()) for z in (x, y)]
            assert sig[0] & sig[1]


def test_lines_with_common_keys_and_templates(spark, monkeypatch):
    rng = random.Random(9)
    common = ["the", "of", "and", "to"]
    rows = [(k, "\n".join(" ".join([*common, "posted", "by", rng.choice(["ann", "bob", "cy"]), f"n{rng.randrange(40)}", f"m{rng.randrange(6)}"][: rng.randrange(5, 10)]) for _ in range(4))) for k in range(120)]
    base = [f"u{j}" for j in range(40)]
    rows += [(1000 + k, " ".join(w if rng.random() > 0.06 else f"e{rng.randrange(9)}" for w in base)) for k in range(60)]
    docs = frame(spark, [(k, t, "en", "a", 1) for k, t in rows]).repartition(3)
    for hubs, tried, rare in ((32, 4096, 12), (1, 2, 3), (3, 9, 0)):
        monkeypatch.setattr(line_dedup, "HUBS", hubs)
        monkeypatch.setattr(line_dedup, "TRIED", tried)
        monkeypatch.setattr(line_dedup, "RARE", rare)
        cloudpickle.register_pickle_by_value(line_dedup)  # tasks take these bounds too
        line_dedup.prefix_lengths.cache_clear()
        try:
            assert Counter(map(tuple, line_dedup.dedup_lines(docs).collect())) == brute_lines(rows)
        finally:
            cloudpickle.unregister_pickle_by_value(line_dedup)


# compaction


def test_compaction(spark, docs, tmp_path):
    store = compaction.ShardStore(spark, f"{tmp_path}/store", target_bytes=40_000, fan_in=3)
    for k in range(5):
        store.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)) == k).repartition(2))
        store.compact()
    assert Counter(map(tuple, store.read().collect())) == Counter(map(tuple, docs.collect()))
    assert store.read(1).count() < docs.count() and any(r.merges for r in store.runs())
    with pytest.raises(compaction.CommitConflict):
        store.commit([], store.version() - 1)
    before = store.version()
    store.append(docs.where("false"))
    assert store.read().count() == docs.count() and store.version() == before + 1
    store.vacuum()
    assert store.read().count() == docs.count()


def test_compaction_of_nothing(spark, nothing, tmp_path):
    store = compaction.ShardStore(spark, f"{tmp_path}/store")
    with pytest.raises(ValueError):
        store.read()
    assert store.append_arrivals(nothing.withColumn("arrival", F.lit(1)), "arrival") == []
    assert store.read().count() == 0 and store.read().columns == nothing.columns


# token output


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 4096, 4097, 9000):
        for top in (1, 2, 300, 50_257, 1 << 31, 1 << 60, 1 << 63):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            ids[rng.random(n) < 0.3] = 0
            words, offsets, escapes = simple8b.encode(ids)
            assert (simple8b.decode(words, n, offsets, escapes) == ids).all() and len(offsets) == -(-n // simple8b.BLOCK)


def test_simple8b_packs_small_ids():
    assert len(simple8b.encode(np.zeros(240, np.uint64))[0]) == 16
    assert len(simple8b.encode(np.ones(60, np.uint64))[0]) == 8


def test_token_shards(spark, docs):
    from tokenizers import Tokenizer

    path = common.shared_dir(spark)
    tokens.write_token_shards(docs, path, tokens.tokenizer_path())
    rows = tokens.read_token_shards(spark, path).collect()
    library = Tokenizer.from_file(tokens.tokenizer_path())
    expected = Counter()
    for r in awkward():
        expected[r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids + [0])] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == expected
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and rows[0].doc_id is None
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


@pytest.mark.parametrize("text", ["a  b", "a \n b\n\n c", " lead", "tail ", "a<|endoftext|> b", "\t x　y  z's don't 12,3", "", "x\n  b", "'s 't", "end.\nNew, line", "é.\n\nà", "\x1c a\x85 b"])
def test_pieces_give_the_ids_of_the_whole(text):
    encode = tokens.encoder(tokens.tokenizer_path())
    assert encode([text])[0].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


# mixing


def test_mix_targets_and_copies(docs):
    plan = mixing.plan_mix(docs).collect()
    size = Counter()
    for r in awkward():
        size[r[3]] += len(re.findall(WORD, r[1] or ""))
    target, taken, most = {}, Counter(), Counter()
    for r in plan:
        target[r.source] = r.target
        assert r.source_size == size[r.source] and r.copy <= 2
        if r.copy:
            taken[r.source] += r.size
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    largest = max(len(re.findall(WORD, r[1] or "")) for r in awkward())
    assert all(t <= 2 * size[s] + 1e-9 and abs(taken[s] - t) <= largest for s, t in target.items())
    positions = [r.position for r in plan if r.copy]
    assert min(positions) >= 0 and max(positions) <= sum(target.values()) + 1e-6
    del most


def test_mix_keeps_repeated_rows_apart(spark, tmp_path):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y"), (None, "x y"), (2, "k"), (2, "k l")] + [(k, "w " * (k % 7)) for k in range(10, 60)]
    docs = frame(spark, [(k, t, "en", "abc"[(k or 0) % 3], 1) for k, t in rows])
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    mine = mixing.op4_curriculum_mix(spark, str(tmp_path)).toPandas()
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    theirs = duck.sql(mixing.OP4_SQL).df()
    sort = lambda x: sorted(tuple(map(str, r)) for r in x.assign(doc_id=x.doc_id.fillna(-1).astype(int))[sorted(x.columns)].itertuples(index=False))
    assert sort(mine) == sort(theirs) and len(mine) == len(rows) and (mine.taken <= 2 * mine["size"]).all()
    copies = Counter()
    for r in mixing.plan_mix(docs).where("copy > 0").collect():
        copies[r.doc_id, r.size] += 1
    assert Counter((r.doc_id, len((r.text or "").split())) for r in mixing.mix(docs).collect()) == copies


def test_mix_positions_are_words_before(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randrange(1, 40), "en", "abcd"[k % 4], 1) for k in range(800)]
    plan = sorted(((r.position, r.doc_id, r.size) for r in mixing.plan_mix(frame(spark, rows)).where("copy > 0").collect()))
    before = 0
    for position, _, size in plan:
        assert abs(position - before) <= 4 * 40  # a document of each source
        before += size


def test_mix_follows_the_schedule(spark):
    rows = [(k, "w " * 10, "en", "abc"[k % 3], 1) for k in range(900)]
    plan = mixing.plan_mix(frame(spark, rows)).where("copy > 0").toPandas()
    middle = plan.groupby("source").position.mean()
    assert middle["a"] < middle["b"] < middle["c"]  # fading, steady, rising


def brute_positions(rows):
    """(doc_id, text) in training order, by walking each source along its own integrated schedule with plain numbers."""
    size = lambda r: len(re.findall(WORD, r[1] or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: sorted((r for r in rows if r[3] == s), key=lambda r: ("" if r[0] is None else hashlib.md5(str(r[0]).encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r))) for s in sources}
    total = {s: sum(map(size, of[s])) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    target, left, share = {}, list(sources), 1.5 * sum(total.values())
    while left:  # fill those that reach their cap, share the rest anew
        full = [s for s in left if 2 * total[s] <= weight[s] * share / sum(weight[t] for t in left)]
        if not full:
            target |= {s: weight[s] * share / sum(weight[t] for t in left) for s in left}
            break
        for s in full:
            target[s], share = 2.0 * total[s], share - 2 * total[s]
            left.remove(s)
    knots = {s: mixing.SCHEDULES[k % 3] for k, s in enumerate(sources)}

    def demand(s, t):
        ends = knots[s]
        at = lambda u: ends[0] + (ends[1] - ends[0]) * 2 * u if u <= 0.5 else ends[1] + (ends[2] - ends[1]) * 2 * (u - 0.5)
        area = lambda u: (ends[0] + at(u)) / 2 * u if u <= 0.5 else (ends[0] + ends[1]) / 4 + (ends[1] + at(u)) / 2 * (u - 0.5)
        return area(t) / area(1.0)

    out = []
    for s in sources:
        if not total[s]:
            continue
        whole, before = int(target[s] // total[s]), 0
        for r in of[s]:
            more = 2 * before + size(r) <= 2 * (target[s] - whole * total[s])
            for copy in range(min(2, whole + more)):
                x, low, high = min(1.0, (copy * total[s] + before) / target[s]), 0.0, 1.0
                for _ in range(60):
                    middle = (low + high) / 2
                    low, high = (middle, high) if demand(s, middle) < x else (low, middle)
                out.append((sum(target[t] * demand(t, high) for t in sources if total[t]), r[0], r[1]))
            before += size(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_rows_in_order(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["a", "a", "b", "c", None]), k) for k in range(300)] + [(400, None, "en", "a", 1)]
    docs = frame(spark, rows).repartition(5)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]  # parts in order, each sorted
    expected = brute_positions(rows)
    assert Counter(got) == Counter(e[1] for e in expected)
    place = defaultdict(list)
    for p, d, _ in expected:
        place[d].append(p)
    for v in place.values():
        v.sort()
    seen = Counter()
    walked = []
    for d in got:
        walked.append(place[d][seen[d]])
        seen[d] += 1
    assert all(b >= a - 1e-3 for a, b in zip(walked, walked[1:]))


# repeated strings


def brute_strings(rows, length: int) -> Counter:
    at = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = Counter()
    for doc_id, t in rows:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if at[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(c for c, v in zip(t, covered) if not v)
        out[doc_id, kept, len(t), sum(covered), len([x for x in bytes(covered).split(b"\0") if x])] += 1
    return out


@pytest.mark.parametrize("length", [16, 41])
def test_suffix_dedup(docs, length):
    got = Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup_strings(docs, length).collect())
    assert got == brute_strings([(r[0], (r[1] or "").encode()) for r in awkward()], length)


@pytest.mark.parametrize("slab", [1_000_000, 1_500])
def test_suffix_dedup_at_400_bytes(spark, monkeypatch, slab):
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdeé fgh\n") for _ in range(n))
    shared = [prose(n) for n in (399, 401, 450, 1200)]
    texts = [prose(rng.randrange(0, 900)) + rng.choice(shared) + prose(rng.randrange(0, 900)) for _ in range(14)]
    texts += ["ab" * 900, prose(500) + "ab" * 450, shared[3][:700] + prose(40) + shared[3][300:], texts[0], texts[0], None, "", "x" * 399, "x" * 400]
    texts += [prose(200) + shared[3][100:520] + "|" + shared[3][100:520]]
    docs = frame(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)]).repartition(4)
    monkeypatch.setattr(suffix_dedup, "SLAB", slab)
    cloudpickle.register_pickle_by_value(suffix_dedup)
    try:
        got = Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup_strings(docs.withColumn("name", F.lit(1)).withColumn("rank", F.lit(1))).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    assert got == brute_strings([(k, (t or "").encode()) for k, t in enumerate(texts)], 400)


def test_suffix_dedup_in_slabs(monkeypatch):
    text = (b"abcdefghij" * 30 + bytes(range(200))) * 2
    whole = [(a, n) for a, n, *_ in suffix_dedup.windows(text, 40)]
    monkeypatch.setattr(suffix_dedup, "SLAB", 64)
    parts = [(a, n) for a, n, *_ in suffix_dedup.windows(text, 40)]
    cover = lambda runs: sorted(p for a, n in runs for p in range(a, a + n))
    assert cover(whole) == cover(parts) == list(range(len(text) - 39))


# simhash


def brute_fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + n]).encode(), seed=42).intdigest() for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs):
    rows = awkward()
    prints = [brute_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    lowest = defaultdict(lambda: None)
    for g, r in zip(group, rows):
        if r[0] is not None:
            lowest[g] = r[0] if lowest[g] is None else min(lowest[g], r[0])
    expected = Counter((r[0], p, lowest[g]) for r, p, g in zip(rows, prints, group))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(docs).collect()) == expected
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect() if r.doc_id is not None]
    assert set(kept) == {c for _, _, c in expected if c is not None}


def test_large_buckets_link_like_small_ones(spark, monkeypatch):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    prints = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for s in seeds for _ in range(60)})
    rows = frame(spark, [(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = []
    for bucket in (1, 1000):
        monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
        links = simhash.fingerprint_links(rows)
        found.append({r.node: r.component for r in common.components(links).collect()})
    assert found[0] == found[1] and found[0]


# quality


def test_quality_counts(docs, labels):
    got = Counter((r.doc_id, r.of.n_words, r.of.word_chars, r.of.n_symbols, r.of.n_dup_lines, r.of.n_repeat_words, r.base_failed) for r in quality.judge(docs, labels).collect())
    expected = Counter()
    for r in awkward():
        text = r[1] or ""
        words, at = re.findall(WORD, text), defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i : i + 8])].append(i)
        covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        expected[r[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)] += 1
    assert got == expected


def test_rules_find_what_marks_poor_rows(spark):
    rows = [(k, " ".join(f"word{k * j % 97}" + ("%%%" if k % 5 == 0 else "") for j in range(60)), "en", "a", 1) for k in range(400)]
    docs = frame(spark, rows)
    labels = frame(spark, [(k, int(k % 5 > 0), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept and all(k % 5 for k in kept)
    assert {r.doc_id for r in quality.drop_poor(docs, labels).collect()} == kept


def plain_rules(rows):
    """learn_rules by trying every threshold on every row; rows are (statistics, poor, grow)."""
    def rounded(x):
        if x <= 0:
            return 0.0
        unit = 10.0 ** (math.floor(math.log10(x)) - 2)
        return math.floor(x / unit + 0.5) * unit

    cuts = {f: sorted({float(np.percentile([rounded(float(r[0][f])) for r in rows], 100 * k / 32)) for k in range(1, 32)}) for f in quality.FEATURES} if rows else {}
    holds = lambda c, of: (of[c[0]] >= c[2]) if c[1] else (of[c[0]] < c[2])
    marked = lambda rule, of: all(holds(c, of) for c in rule)
    rules = []
    while len(rules) < 8:
        left = [r for r in rows if not any(marked(x, r[0]) for x in rules)]
        grown = []
        while len(grown) < 3:
            now = [r for r in left if r[2] and marked(grown, r[0])]
            p0, n0 = sum(r[1] for r in now), sum(not r[1] for r in now)
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in quality.FEATURES:
                for cut in cuts[f]:
                    for up in (False, True):
                        mine = [r for r in now if holds((f, up, cut), r[0])]
                        p = sum(r[1] for r in mine)
                        gain = quality._gain(p0, n0, p, len(mine) - p)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, up, cut))
            if best[1] is None:
                break
            grown.append(best[1])
        if not grown:
            break
        worth = []
        for k in range(len(grown)):
            mine = [r for r in left if not r[2] and marked(grown[: k + 1], r[0])]
            p = sum(r[1] for r in mine)
            worth.append((round((2 * p - len(mine)) / max(1, len(mine)), 9), -k, p, len(mine)))
        _, k, p, n = max(worth)
        if p < 8 or p < 0.95 * n:
            break
        rules.append(grown[: 1 - k])
    return rules, marked


def test_drop_poor_by_plain_rules(spark):
    rng = random.Random(11)
    rows, marks = [], []
    for k in range(500):
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(15, 80))]
        poor = rng.random() < 0.3
        if poor and rng.random() < 0.9:
            words = [w.upper() if rng.random() < 0.4 else w + "!" for w in words] if k % 2 else words + ["%%#"] * rng.randrange(4, 9)
        rows.append((k, " ".join(words), "en", "a", 1))
        if k % 5:
            marks.append((k, int(not poor), 0))
    rows += [(None, rows[3][1], "en", "a", 1), (600, None, "en", "a", 1), rows[7], (601, "", "en", "a", 1)]
    docs, labels = frame(spark, rows).repartition(3), frame(spark, marks, "doc_id long, quality int, toxic int")
    of = {(r.doc_id, r.text): r.of.asDict() for r in docs.select("doc_id", "text", quality.text_statistics(common.text_of()).alias("of")).collect()}
    base = lambda s: s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]
    poor = {d: q == 0 for d, q, _ in marks}
    learned = [(of[r[0], r[1]], poor[r[0]], zlib.crc32(str(r[0]).encode()) % 2 == 0) for r in rows if r[0] in poor and not base(of[r[0], r[1]])]
    rules, marked = plain_rules(learned)
    assert rules
    kept = Counter(r[:2] for r in rows if not base(of[r[0], r[1]]) and not any(marked(x, of[r[0], r[1]]) for x in rules))
    assert Counter((r.doc_id, r.text) for r in quality.drop_poor(docs, labels).collect()) == kept
    assert Counter(r.doc_id for r in quality.judge(docs, labels).where("kept").collect()) == Counter(k[0] for k in kept.elements())


# toxicity


def test_toxicity(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    rows, marks = [], []
    for k in range(600):
        toxic = k % 4 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(["zvzvzvz", "qxqxqxq"])
        rows.append((k, " ".join(text), "en", "a", 1))
        marks.append((k, 1, int(toxic)))
    rows += [(None, "zvzvzvz", "en", "a", 1), (1000, None, "en", "a", 1), (1001, "", "en", "a", 1)]
    got = toxicity.toxicity(frame(spark, rows), frame(spark, marks, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95


def test_toxicity_features_against_plain_python(spark, docs):
    ordinary, toxic = b"common words of every day and more of them " * 8, b" zvzvzvz  qxqxqxq "
    plain, other = toxicity._compressor(ordinary), toxicity._compressor(toxic + ordinary)
    extra = [(900, "zvzvzvz " * 9 + "x" * 300, "en", "a", 1), (901, "Common WORDS of every day zvzvzvz", "en", "a", 1)]
    expected = Counter()
    for r in awkward() + extra:
        text = " " + " ".join(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) + " "
        raw, gains, at = text.encode(), [], 0
        while at == 0 or at < len(raw) - 12:
            window = toxicity.PRIMER + raw[at : at + 56]
            gains.append(len(plain(window)) - len(other(window)))
            at += 44
        expected[r[0], len(gains), max(0, *gains, 0), sum(g >= 3 for g in gains)] += 1
    both = docs.unionByName(frame(spark, extra)).withColumn("windows", F.lit(1))
    assert Counter(map(tuple, toxicity.window_features(both, ordinary, toxic).collect())) == expected


def test_both_dictionaries_are_trained():
    rng = random.Random(1)
    ordinary = {"".join(rng.choice("abcdefgh") for _ in range(6)): 9 for _ in range(2000)}
    toxic = {"zvzvzvz": 300, "qxqxqxq": 200}
    held = [[rng.choice(list(toxic))] for _ in range(400)]
    both = toxicity.train_dictionaries(toxic, ordinary, held)
    assert b"zvzvzv" in both[1] and b"qxqxqx" in both[1] and b"zvzv" not in both[0] and len(both[0]) <= toxicity.ORDINARY_BYTES


def test_toxicity_with_one_class(spark, docs):
    one = frame(spark, [(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, one).collect()} == {0}


# language model: see test_pseudo_likelihood.py


# decontamination


def test_leaks(spark, docs):
    rows = awkward()
    words = re.findall(WORD, rows[0][1])
    items = [(1, " ".join(words[3:14]).upper()), (2, " ".join(words[:9] + ["no", "such"])), (3, None), (4, ""), (5, "w1 w2"), (6, "one"), (6, "one"), (7, " ".join(words))]
    table = frame(spark, items, "item_id long, text string")
    expected = {}
    for item_id, item in items:
        w = re.findall(WORD, (item or "").lower())
        if not w:
            continue
        n = min(5, len(w))
        mine = {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
        for r in rows:
            d = re.findall(WORD, (r[1] or "").lower())
            held = mine & {" ".join(d[i : i + n]) for i in range(len(d) - n + 1)}
            if r[0] is not None and len(held) >= 0.8 * len(mine) - 1e-9:
                expected[r[0], item_id] = (len(mine), max(len(held), expected.get((r[0], item_id), (0, 0))[1]))
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontamination.leaks(docs, table).collect()} == expected
    gone = {d for d, _ in expected}
    assert Counter(r.doc_id for r in decontamination.drop_leaks(docs, table).collect()) == Counter(r[0] for r in rows if r[0] not in gone)


def test_simhash_digest(spark, sf_dir):
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in simhash.op6_simhash(spark, sf_dir).limit(20).collect())


def test_kept_bytes_hash(spark, sf_dir):
    rows = suffix_dedup.op5_suffix_dedup(spark, sf_dir).where("n_removed = 0").limit(5).collect()
    texts = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    assert all(r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_line_keys_take_few_bytes_and_lone_words_none(spark):
    """Keys of lines take less than 24 bytes each, and words that one line has aren't keys."""
    rng = random.Random(31)
    common = [f"w{k}" for k in range(400)]
    rows = [(k, "\n".join(" ".join([f"lone{k}x{j}", *rng.choices(common, k=14)]) for j in range(12))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = np.zeros(line_dedup.COUNT_BUCKETS, np.int64)
    sets = [line_dedup.line_sets(pa.array([t])) for _, t in rows]
    for name, *_ in sets:
        np.add.at(counts, (name % np.uint64(line_dedup.COUNT_BUCKETS)).astype(np.int64), 1)
    rarity = line_dedup.rarities(counts)
    got = line_dedup._packed_keys(docs, rarity, 16, (0, 399)).toArrow()
    keys = sum(len(v) for v in got.column("keys").to_pylist()) // 4
    lone, kept = {n for name, *_ in sets for n in name.tolist() if rarity[n % line_dedup.COUNT_BUCKETS] == 1}, 0
    for part, held in zip(got.column("part").to_pylist(), got.column("keys").to_pylist()):
        kept += len(set(np.frombuffer(held, np.uint32).tolist()) & {n & 0xFFFFFFFF for n in lone if (n >> 32) % 16 == part})
    assert keys and kept == 0
    assert sum(len(v) for c in got.column_names[1:] for v in got.column(c).to_pylist()) < 24 * keys


def test_squeezed_numbers_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 2, 1000):
        columns = [rng.integers(0, 65_536, n).astype(np.uint16), rng.integers(0, 65_536, n).astype(np.uint16), rng.integers(0, 4_000_000_001, n).astype(np.uint32)]
        back = line_dedup.unsqueezed(pa.py_buffer(line_dedup.squeezed(*columns)), n)
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, back))
