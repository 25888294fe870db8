"""Shared pieces of the training-data operators: text columns, scratch tables, size-checked joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: the space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bare id list that may be broadcast (about 16 MB); beyond it the same join shuffles.
BROADCAST_IDS = 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; a folder of its own only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = getattr(spark, "_lapwing_scratch", None) or tempfile.mkdtemp(prefix="lapwing-")
        spark._lapwing_scratch = base
    return f"{base.rstrip('/')}/lapwing-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage, and lost executors lose nothing.

    The shuffles of the write are needed no longer once it is done, so their files go at its end.
    """
    spark, path = df.sparkSession, path or shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    if before is not None:  # known to this version
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank: 1, 2, 3 ... in the given order, a total one or else ties in some order. Written to the shared folder.

    Rows are dealt by range of the order and sorted inside each range; a row's rank is the number of rows in the ranges before
    it plus its place in its own. No task sees more than a range, and only one count a range is summed up in one place.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = saved(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = laid.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counts.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    found = laid.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.withColumn("rank", place + F.col("_offset") + 1).drop("_at", "_part", "_offset")


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key isn't among ids (a table of one column, read twice). A short list is broadcast; a long one shuffles.

    Rows whose key is null stay.
    """
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is among ids, by the same size check."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, "left_semi")


def spare(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has, in any case of letters: the given one with underscores behind it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """docs without the rows whose text's xxhash64 is among texts (a column th, read twice), whatever their doc_id."""
    th = spare("_th", docs)
    return without_ids(docs.withColumn(th, F.xxhash64("text")), texts.select(F.col("th").alias(th)), th).select(*docs.columns)


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text's xxhash64 are among rows (doc_id, th; read twice); null ids are equal."""
    doc_id, of, th = spare("_id", docs), spare("_of", docs), spare("_th", docs)
    rows = rows.select(F.col("doc_id").alias(doc_id), F.col("th").alias(of))
    if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    hashed = docs.withColumn(th, F.xxhash64("text"))
    return hashed.join(rows, F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col(th) == F.col(of)), "left_anti").select(*docs.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs: (node, component), component the smallest node reachable.

    Alternates the large-star and small-star steps until the edges stay as they are; each round is a
    written table. Neighbour lists are never gathered: each step is a minimum by node and a join. Edges
    with a null end and self-loops are left out; no edge gives no row.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    path, last = shared_dir(spark), None
    now = saved(now, path)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = shared_dir(spark)
        now = saved(small.select("e.*").where("u <> v").distinct(), after)
        drop_path(spark, path)
        path = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())
