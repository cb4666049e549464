"""Session settings that results rely on, and cuts of long lineages."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def settle(spark: SparkSession) -> SparkSession:
    """Keeps Spark from taking a union's partitioning for that of its children.

    With adaptive execution, children may be read with different partition counts, and an aggregate after such a union then
    leaves out the exchange it needs and returns a key twice.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, one of our own, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "bytefacts-checkpoints")
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df to the shared checkpoint folder, from where any executor can read it again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
