"""Shared plumbing: reading tables, shipping the package to workers, row-wise Arrow kernels."""

from __future__ import annotations

import contextlib
import os
import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefacts import session
from bytefacts.session import settle, shared_dir

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows and bytes that an Arrow batch of texts holds at most, in the JVM and in a worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when it is run from a source tree, and keeps the batches they get small."""
    env = spark.sparkContext.environment
    have = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    for name, most in BATCH.items():
        now = re.match(r"\d+$", spark.conf.get(name, None) or "")
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(name, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """n names that no column of df has, in any case."""
    have, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"own_{k}") not in have:
            out.append(name)
        k += 1
    return out


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text); extra columns, whatever their names, are left behind."""
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))


def map_texts(docs: DataFrame, schema: str, kernel: Callable[[list, list], dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kernel(ids, texts) -> columns by name, over Arrow batches; null texts come as ''.

    No shuffle: one row in, as many out as the kernel makes. Batches are cut to
    about 4 MB of text so that a worker's memory does not depend on how long texts are.
    """
    spark = docs.sparkSession
    ship(spark)
    target = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                out = kernel(ids, [t or "" for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return documents(docs, id_col, text_col).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text_col: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most `limit` bytes of text, or of one row."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(lengths):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a finished query are removed at once, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """As session.cut, and what was shuffled for it is removed at once."""
    with tidy(df.sparkSession):
        return session.cut(df)


@contextlib.contextmanager
def stored(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df, written once as a table in the shared folder, which is deleted at the end of the block."""
    spark, at = df.sparkSession, fresh_path(df.sparkSession, name)
    try:
        with tidy(spark):
            df.write.parquet(at)
        yield spark.read.schema(df.schema).parquet(at)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, written once and counted: marked for broadcast if it has at most `most` rows, else left to a shuffled join."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df
