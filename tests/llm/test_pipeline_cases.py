"""The pipeline's stages on empty tables and on documents whose columns carry the operators' own names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapwing.llm.common import saved, spare, table

CLASH = ("_th", "_id", "_of", "_mix_id", "_mix_source", "_mix_hash", "_mix_n", "_mix_position", "_mix_of", "_at", "_part", "_arrival", "th", "fp", "group", "words", "hash", "copy", "place")


def through(spark, docs, sf_dir):
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    return docs


def test_clashing_columns_change_nothing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    twice = docs.unionAll(docs.limit(3)).unionAll(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    plain = {tuple(r) for r in through(spark, twice, sf_dir).collect()}
    clash = twice.select("*", *[F.lit(7).alias(c) for c in CLASH])
    kept = through(spark, clash, sf_dir)
    assert {tuple(r) for r in kept.collect()} == plain


def test_users_values_stay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("*", *[F.lit(7).alias(c) for c in CLASH])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    assert docs.count() and all(docs.where(F.col(c) != 7).isEmpty() for c in CLASH)


@pytest.mark.parametrize("empty", ["documents", "texts"])
def test_empty_tables(spark, sf_dir, empty):
    docs = table(spark, sf_dir, "documents").limit(0 if empty == "documents" else 5)
    out = through(spark, docs.withColumn("text", F.lit(None).cast("string")), sf_dir)
    assert out.count() == 0


def test_files_are_numbered(spark, tmp_path):
    names = ["part-99999-x.parquet", "part-100000-x.parquet", "part-00002-x.parquet", "other.parquet"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(*corpus_pipeline.file_order(F.col("n"))).collect()]
    assert got == ["other.parquet", "part-00002-x.parquet", "part-99999-x.parquet", "part-100000-x.parquet"]


def test_spare_names(spark):
    one, two = spark.createDataFrame([(1, 2)], "_TH int, _id_ int"), spark.createDataFrame([(1,)], "_id int")
    assert spare("_th", one) == "_th_" and spare("_id", one, two) == "_id__" and spare("x", one) == "x"
