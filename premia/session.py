"""Session settings every job here relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins at run time: it broadcasts a side only when its measured size is under
# the threshold and splits partitions that one hot key has filled.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the SQL options the operators assume; cluster sizing is left to the cluster."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "premia", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only a session of one process without that setting gets a folder of its own; a cluster without
    it is refused, because executors could not see a machine-local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` on unique ``keys`` if it has fewer partitions than the cluster has cores.

    For work that is heavy per row (splitting text, sketches) on a table that came as one or two
    files. A table of many files is returned as it is, without a shuffle. There are at least two new partitions for
    each old one, so a task reads no more than half of what Spark's splits of a file hold.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.rdd().getNumPartitions()
    if splits >= 2 * cores:
        return df
    return df.repartition(max(cores, 2 * splits), *keys)
