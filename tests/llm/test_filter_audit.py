"""The filter audit against replaying every order on every document."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from lapwing.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, rank int, mask int, n int, part string"


def awkward() -> list[tuple]:
    long = " ".join(f"w{k}" for k in range(220))
    texts = [long, long + " #", long.upper(), "a b " * 150, "x", "", None, "A " * 300, long, "a b " * 150, " \n\t", "É" * 40 + " " + long, "#|" * 5]
    rows = [(k, texts[k % len(texts)], ["en", "de", None, "", "fr"][k % 5], 1, 1, 1, "p") for k in range(90)]
    return rows + [(None, long, "en", 1, 1, 1, "p"), (None, None, None, 1, 1, 1, "p"), rows[0], rows[0], rows[3], (7, long, "en", 1, 1, 1, "p")]


def failing(row: tuple, first: dict) -> str:
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
        row[0] is not None and first.get(text, row[0]) < row[0],
    )
    return "".join(f for f, failed in zip("ABCDE", tests) if failed)


def brute(rows: list[tuple], labels: list[tuple]) -> Counter:
    first: dict[str, int] = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    of_part: dict[str, list] = {}
    for r in rows:
        of_part.setdefault(r[2] or "", []).append((failing(r, first), r[0] in good, r[0] in toxic))
    out = []
    for part, docs in of_part.items():
        steps, total = [], Counter()
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(gone)
                steps.append((part, "".join(order), k, len(left), len(gone), redundant, sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
                total[f] += len(gone)
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return Counter(out)


def test_every_order_replayed(spark):
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 60, 2)] + [(0, 0, 1), (0, 1, 0), (None, 1, 1), (5, None, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Counter(map(tuple, filter_audit.audit_filters(docs, of).collect()))
    assert got == brute(awkward(), labels)
    assert filter_audit.audit_filters(docs.limit(0), of).count() == 0
    assert filter_audit.audit_filters(docs, of.limit(0)).count() == sum(got.values())


def test_ranks_and_intervals():
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert [filter_audit.lehmer_rank(p) for p in orders] == list(range(120))
    for mask, step, start, stop in filter_audit.removal_intervals():
        failed = {f for k, f in enumerate("ABCDE") if mask >> k & 1}
        assert all(next(i for i, f in enumerate(p, 1) if f in failed) == step for p in orders[start:stop])
    for mask in range(1, 32):  # each order removes a mask once
        held = [r for m, _, a, b in filter_audit.removal_intervals() if m == mask for r in range(a, b)]
        assert sorted(held) == list(range(120))


def test_parts_of_other_filters(spark):
    counts = spark.createDataFrame([("x", 1, 4, 1, 0), ("x", 3, 2, 0, 1), ("x", 0, 1, 0, 0), ("x", 4, 3, 3, 3)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit_orders(counts, "ABC").collect()}
    assert len(rows) == 18
    assert rows["BAC", 1].removed == 2 and rows["BAC", 2].removed == 4 and rows["BAC", 2].redundant == 2 and rows["BAC", 3].kept == 1
