"""Session helpers: checkpoint location, scan spreading, table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition where partitions follow the table's size.
PART_ROWS = 250_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch folder only for local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="wardstone-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder on the storage that also holds the checkpoints (shared on a cluster)."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise an iteration's result on reliable storage, so that plans stay short and a
    lost executor never costs more than the current round. The partitioning survives."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for per-row heavy work when a table scan yields fewer partitions than
    there are cores (small tables in one row group). A no-op for large inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by keys over partitions of about PART_ROWS rows, at least as many as a shuffle has, so
    that what one task reads and holds does not grow with the table. Frames of one join are given
    the same ``rows``."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // PART_ROWS)), *keys)
