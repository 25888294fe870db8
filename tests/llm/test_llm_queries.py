"""Registered training-data queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from lapwing.llm.common import saved, table
from lapwing.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf_dir):
    duck = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        duck.sql(f"create view {f.stem} as select * from '{f}'")
    mine, theirs = QUERIES[name](spark, sf_dir), duck.sql(ORACLE[name])
    rows = lambda columns, found: sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in found)
    assert sorted(mine.columns) == sorted(theirs.columns) and rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir))
        counts.append(docs.count())
        if name == "benchmark_decontamination":
            kept = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    rows = docs.orderBy("start").collect()
    assert [r.start for r in rows[1:]] == [r.start + r.n_tokens for r in rows[:-1]]
    assert {r.doc_id for r in rows} <= {r.doc_id for r in kept.select("doc_id").collect()}
