"""Session settings and the few places where a job must know its cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "loomstone", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators are written for.

    Shuffle partitions are left to the caller: adaptive execution coalesces
    small ones, a cluster job sets the number from its input size.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the cluster's shared one; a local one only where driver and executors are one process."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomstone-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and go on from there.

    Lineage ends at files that outlive any executor. A table, unlike a
    checkpointed plan, claims no partitioning that adaptive execution may have
    changed while it ran, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan that has fewer splits than the cluster has cores.

    A large input already has many more splits than cores and is returned as
    it is; only a small file read by a CPU-heavy stage is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
