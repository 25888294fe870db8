"""Sharding by size-tiered compaction: immutable shards, merged as runs of similar size, under versioned manifests.

A store is a folder: runs/ holds folders of Parquet shards that are never changed, versions/ one JSON manifest for
each version. A version is committed by a rename that fails if the name is taken, so readers see whole versions
only and of two writers of one version the second must read again. DataFrame operations write and read the shards.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapwing.llm.common import drop_path, shared_dir, spare, table

TARGET_BYTES, FAN_IN = 128 << 20, 4
#: Runs whose sizes are within this factor of their group's mean, up or down, are similar.
SIMILAR = 0.5
ARRIVALS = 12


class CommitConflict(RuntimeError):
    """Another writer has committed this version first; read the store again."""


@dataclass(frozen=True)
class Run:
    """An immutable folder of shards: its path below the store, its files and their bytes, and how often its rows were merged."""

    path: str
    files: tuple[str, ...]
    bytes: int
    merges: int


class ShardStore:
    """Shards in a folder on any file system that Spark writes to.

    Rows may hold anything, nulls and repeated rows included, and come back as they are, in no order. An arrival of no rows
    commits a version without a new run.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, below: str):
        return self._hadoop.Path(f"{self.root}/{below}")

    def _fs(self):
        return self._path("versions").getFileSystem(self._conf)

    def _list(self, below: str) -> list[tuple[str, int]]:
        """(name, bytes) of what lies in a folder."""
        if not self._fs().exists(self._path(below)):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs().listStatus(self._path(below)))

    def version(self) -> int:
        """The latest version, 0 for an empty store."""
        return max((int(name[1:-5]) for name, _ in self._list("versions") if name.startswith("v")), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"runs": [], "schema": None}
        stream = self._fs().open(self._path(f"versions/v{version:08d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(r["path"], tuple(r["files"]), r["bytes"], r["merges"]) for r in self._manifest(version)["runs"]]

    def commit(self, runs: list[Run], base: int, schema: StructType | None = None) -> int:
        """Make runs the version after base, or raise CommitConflict if there is one already. The schema stays unless given."""
        fs, version = self._fs(), base + 1
        columns = schema.jsonValue() if schema else self._manifest(base)["schema"]
        fs.mkdirs(self._path("versions"))
        written = self._path(f"versions/.{uuid.uuid4().hex}")
        out = fs.create(written, False)
        out.write(bytearray(json.dumps({"version": version, "schema": columns, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(fs.getUri(), self._conf).rename(written, self._path(f"versions/v{version:08d}.json"), options)
        except Exception as error:
            fs.delete(written, False)
            if "FileAlreadyExists" in str(error):
                raise CommitConflict(f"version {version} is taken") from error
            raise
        return version

    def _run(self, path: str, merges: int) -> Run | None:
        files = [(name, n) for name, n in self._list(path) if name.endswith(".parquet")]
        return Run(path, tuple(name for name, _ in files), sum(n for _, n in files), merges) if files else None

    def append(self, rows: DataFrame) -> int:
        """Write rows as one run of small shards, a shard for each task, and commit it."""
        path = f"runs/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        return self._append(path, rows.schema)

    def append_arrivals(self, rows: DataFrame, by: str) -> list[int]:
        """Write the arrivals that column `by` tells apart in one job, then commit them one by one, in its order.

        The column is not kept. Compacts after each commit, as a store that lives does.
        """
        path = f"runs/{uuid.uuid4().hex}"
        rows.write.partitionBy(by).parquet(f"{self.root}/{path}")
        versions = []
        if not self.version():
            self.commit([], 0, rows.drop(by).schema)
        for name, _ in self._list(path):
            if name.startswith(f"{by}="):
                self._append(f"{path}/{name}", rows.drop(by).schema)
                versions.append(self.compact())
        return versions

    def _append(self, path: str, schema: StructType) -> int:
        run, base = self._run(path, 0), self.version()
        return self.commit(self.runs(base) + ([run] if run else []), base, schema)

    def _group(self, runs: list[Run]) -> list[Run]:
        """The smallest group of at least fan_in runs of similar size whose shards aren't of target size yet."""
        group: list[Run] = []
        for run in sorted(runs, key=lambda r: r.bytes):
            if run.bytes >= len(run.files) * self.target_bytes * SIMILAR and run.merges:
                continue
            mean = sum(r.bytes for r in group) / len(group) if group else run.bytes
            if run.bytes > mean / SIMILAR:
                if len(group) >= self.fan_in:
                    break
                group = []
            group.append(run)
        return group if len(group) >= self.fan_in else []

    def compact(self) -> int:
        """Merge groups of similar runs until there are none; each merge is a version. Returns the latest version.

        A merge reads its shards and writes them again as files of about target size, without a shuffle.
        The runs it replaces stay for readers of older versions until vacuum().
        """
        while True:
            base = self.version()
            runs = self.runs(base)
            group = self._group(runs)
            if not group:
                return base
            path = f"runs/{uuid.uuid4().hex}"
            files = max(1, round(sum(r.bytes for r in group) / self.target_bytes))
            self._read(group).coalesce(files).write.parquet(f"{self.root}/{path}")
            merged = self._run(path, max(r.merges for r in group) + 1)
            self.commit([r for r in runs if r not in group] + ([merged] if merged else []), base)

    def vacuum(self) -> None:
        """Delete the runs and versions that the latest version does not need."""
        latest = self.version()
        kept = {r.path for r in self.runs(latest)}
        for version in range(1, latest):
            if self._fs().exists(self._path(f"versions/v{version:08d}.json")):
                for run in self.runs(version):
                    if run.path not in kept:
                        drop_path(self.spark, f"{self.root}/{run.path}")
                self._fs().delete(self._path(f"versions/v{version:08d}.json"), False)

    def _read(self, runs: list[Run], version: int | None = None) -> DataFrame:
        columns = self._manifest(version)["schema"]
        if columns is None:
            raise ValueError("an empty store has no columns yet")
        schema = StructType.fromJson(columns)
        files = [f"{self.root}/{r.path}/{name}" for r in runs for name in r.files]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest unless given. A store to which nothing was appended has no columns and raises ValueError."""
        return self._read(self.runs(version), version)


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a store, in ARRIVALS arrivals by a hash of doc_id, compacted as they come, and read back."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, shared_dir(spark), target_bytes=16 << 20)
    arrival = spare("_arrival", docs)
    store.append_arrivals(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), arrival)
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


OP2_SQL = "select doc_id, lang, source, n_chars, strlen(text)::bigint as n_bytes, md5(text) as text_md5 from documents"
