"""A store of immutable shards with size-tiered compaction and a versioned manifest.

root/data/<run>/part-*.parquet    shards; never changed once written
root/manifest/<run>/              a version's shards: path, bytes, rows
root/versions/<number>            names a manifest; it appears by a rename that fails if the number is taken

A reader takes the highest version and sees that version's shards only; a writer that dies leaves files that no
version names. Compaction merges the shards of a size tier once there are FANOUT of them, as one job without a shuffle:
each task reads whole shards and writes one file of about the target size. Only metadata (a row for each
shard) reaches the driver.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefacts.llm import common

FANOUT, TARGET, SHARD_ROWS = 4, 64 << 20, 250
#: Shards below this are one tier.
SMALLEST = 1 << 20


class VersionTaken(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


def tier(size: int, fanout: int = FANOUT, smallest: int = SMALLEST) -> int:
    """0 below `smallest`, then one more for each factor of `fanout`."""
    return 0 if size < smallest else 1 + int(math.log(size / smallest, fanout) + 1e-9)


def plan(shards: list[Shard], target: int = TARGET, fanout: int = FANOUT, smallest: int = SMALLEST) -> list[list[Shard]]:
    """The runs to merge: all shards of a tier that are smaller than half the target, where there are `fanout` of them or more."""
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: s.path):
        if s.bytes < target / 2:
            tiers.setdefault(tier(s.bytes, fanout, smallest), []).append(s)
    return [run for _, run in sorted(tiers.items()) if len(run) >= fanout]


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.conf)

    def version(self) -> int:
        """The newest version; 0 before the first."""
        at = self._path(f"{self.root}/versions")
        if not self._fs().exists(at):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs().listStatus(at) if f.getPath().getName().isdigit()), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        named = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/versions/{version}").collect()))
        return [Shard(*r) for r in self.spark.read.parquet(named["manifest"]).select("path", "bytes", "rows").orderBy("path").collect()]

    def commit(self, shards: list[Shard], version: int) -> int:
        """Makes `shards` the given version; VersionTaken if there is one of this number, and then nothing changes."""
        name = f"{self.root}/manifest/{uuid.uuid4().hex}"
        rows = [(s.path, s.bytes, s.rows) for s in shards]
        self.spark.createDataFrame(rows, "path string, bytes long, rows long").coalesce(1).write.parquet(name)
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{version}")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "manifest": name}).encode()))
        out.close()
        self._fs().mkdirs(final.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf) if final.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        keep = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, keep)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise VersionTaken(version) from e
            raise
        return version

    def _write(self, df: DataFrame, rows_per_file: int = 0) -> list[Shard]:
        """df as new files that no version names yet."""
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(at)
        files = self.spark.read.schema(df.schema).parquet(at).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count("*").alias("rows"))
        return [Shard(*r) for r in files.collect()]

    def append(self, df: DataFrame, rows_per_file: int = SHARD_ROWS) -> int:
        """Adds an arrival as small shards; an empty one adds a version with no new shard. Retries if others commit meanwhile."""
        new = self._write(df, rows_per_file)
        while True:
            version = self.version()
            try:
                return self.commit([*self.shards(version), *new], version + 1)
            except VersionTaken:
                continue

    def compact(self, target: int = TARGET, fanout: int = FANOUT, smallest: int = SMALLEST) -> int:
        """Merges until no tier has `fanout` shards below half the target. The shards must still be there to commit."""
        while runs := plan(self.shards(), target, fanout, smallest):
            version = self.version()
            now = self.shards(version)
            gone: set[str] = set()
            made: list[Shard] = []
            for run in runs:
                paths = [s.path for s in run]
                files = max(1, round(sum(s.bytes for s in run) / target))
                made += self._write(self.spark.read.parquet(*paths).coalesce(files))
                gone.update(paths)
            if not gone <= {s.path for s in now}:
                continue
            try:
                self.commit([*(s for s in now if s.path not in gone), *made], version + 1)
            except VersionTaken:  # an append came between: what was merged is left unnamed, and planned anew
                continue
        return self.version()

    def vacuum(self) -> int:
        """Deletes shard files that the newest version does not name; readers of older versions must be done. Returns their number."""
        fs, keep, n = self._fs(), {s.path.rpartition("/data/")[2] for s in self.shards()}, 0
        at = self._path(f"{self.root}/data")
        for run in fs.listStatus(at) if fs.exists(at) else []:
            for f in fs.listStatus(run.getPath()):
                name = f"{run.getPath().getName()}/{f.getPath().getName()}"
                if f.getPath().getName().endswith(".parquet") and name not in keep:
                    fs.delete(f.getPath(), False)
                    n += 1
        return n

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version; an empty frame of this schema where it has no shard."""
        paths = [s.path for s in self.shards(version)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def compacted(docs: DataFrame, root: str, target: int = TARGET, fanout: int = FANOUT, rows_per_file: int = SHARD_ROWS) -> DataFrame:
    """docs appended to the store at root, compacted, and read back through the manifest; all columns and rows, nulls and repeats too."""
    store = ShardStore(docs.sparkSession, root)
    store.append(docs, rows_per_file)
    store.compact(target, fanout)
    store.vacuum()
    return store.read(docs.schema)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the compacted store: doc_id, UTF-8 bytes and SHA-256 of its text (null: empty)."""
    kept = compacted(common.read(spark, sf_dir, "documents"), common.fresh_path(spark, "shards"))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return kept.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
