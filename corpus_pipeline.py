"""Documents to training tokens: rule filter, near-duplicate removal, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet and
reads them back as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import saved, shared_dir, table
from lapwing.llm.decontamination import drop_leaks
from lapwing.llm.mixing import mix
from lapwing.llm.near_copies import similar_groups
from lapwing.llm.quality import drop_poor
from lapwing.llm.simhash import drop_near_duplicates
from lapwing.llm.tokens import read_token_shards, tokenizer_path, write_token_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the base rules or the learned decision list reject go."""
    return drop_poor(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 by the stages' rule, SimHash over 5-word shingles verified at similarity 0.8: one row of each group stays, that of the smallest doc_id."""
    return drop_near_duplicates(docs, similar_groups(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents into which a benchmark item has leaked go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents in training order, each as often as its source's target weight asks for."""
    return mix(docs)


def file_order(name: Column) -> list[Column]:
    """Part files by their number, however many digits it has, and others before them by name."""
    return [F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(-1)), name]


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the ids of every text in Simple-8b shards, and from these a row for each document written.

    Documents that come from files keep the files' order, which after mixing is training order; others go by doc_id.
    """
    try:
        number, name = file_order(F.col("_metadata.file_name"))
        docs = docs.select("doc_id", "text", number.alias("_number"), name.alias("_file"), F.col("_metadata.row_index").alias("_place"))
        order: tuple[str, ...] = ("_number", "_file", "_place")
    except AnalysisException:
        order = ("doc_id",)
    path = shared_dir(spark)
    write_token_shards(docs, path, tokenizer_path(), order_by=order)
    return read_token_shards(spark, path, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]
#: The learned rules and the tokenizer have no SQL. Tests hold the operator of each stage against a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else saved(out)
    return docs
