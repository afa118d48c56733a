"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew handling)."""
    builder = (
        SparkSession.builder.appName("tablecraft")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tablecraft-checkpoint-")  # one machine, and gone with this process
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return configured


def spread(scan: DataFrame) -> DataFrame:
    """Give a map-heavy step over a table scan as many tasks as there are cores.

    Meant for scans only (files of few row groups); scans of large tables have more splits than cores
    and pass through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def materialize(df: DataFrame, once: bool = False) -> DataFrame:
    """Compute and cut lineage, on storage that outlives any executor.

    A checkpoint computes its rows twice, to count and to write them. ``once`` keeps the first result in the executors' memory
    and disk until it is written; for results that cost much more to compute than to hold.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not once or df.is_cached:
        return df.checkpoint(eager=True)
    held = df.persist()
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def store(df: DataFrame) -> DataFrame:
    """The rows, computed once, as Parquet in the shared checkpoint folder; lineage ends there.

    For tables that are read many times: a checkpoint is computed twice and read back row by row with all columns.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
