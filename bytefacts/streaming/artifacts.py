"""New artifacts of a folder as a stream, decoded as they arrive; equal contents once within the watermark-free state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefacts.sources.artifacts import decoded


def arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, content, sha256, byte_length of each file that comes into the folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"))


def decoded_once(stream: DataFrame) -> DataFrame:
    """The decoder's rows of each content that has not been seen; the state is a digest for each content."""
    return decoded(stream.dropDuplicates(["sha256"]))
