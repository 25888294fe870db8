"""Each query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lapwing.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        db.sql(f"create view {f.stem} as select * from '{f}'")
    return db


def rows(frame) -> list[tuple]:
    return sorted(tuple(map(str, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, duck, sf_dir):
    mine, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
