"""Session settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Shuffle partitions before adaptive execution merges the small ones.
INITIAL_PARTITIONS = 20_000


def build_session(
    app_name: str = "fleetlens",
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """Return a session with UTC time, ANSI SQL and adaptive execution.

    ``master`` and ``shuffle_partitions`` are left to the cluster when unset;
    adaptive execution then coalesces small partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if master is None and shuffle_partitions is None:
        # Adaptive execution only merges partitions, so a cluster starts with many.
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(INITIAL_PARTITIONS))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared folder for stream checkpoints, which the cluster names in ``spark.checkpoint.dir``.

    There is no fallback: a folder that is new at every start would lose the progress of a stream.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return configured.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """Return a fresh path for tables of one query, in the shared folder.

    Only a session in one process (``local[n]``) may go without ``spark.checkpoint.dir``.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.startswith("local["):
        return f"{tempfile.mkdtemp(prefix='fleetlens-')}/{label}"
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a fresh table in the shared folder and read back: it is computed once and outlives executors."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
