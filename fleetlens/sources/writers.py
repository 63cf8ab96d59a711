"""Writers. All paths must be shared storage when Spark runs on a cluster."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.fmt import iso_text
from fleetlens.sources.versions import Versions


def timing_lines(timings: DataFrame, as_of: Column, *metrics: str) -> DataFrame:
    """JSON line of each timing: workload, time stamp, then the metrics."""
    line = F.to_json(F.struct("workload", iso_text(as_of).alias("ts"), *metrics))
    return timings.withColumn("line", line)


def append_timing(timings: DataFrame, path: str, as_of: Column, *metrics: str) -> None:
    """Append timing lines, one folder per workload so that a reader opens only its own."""
    (
        timing_lines(timings, as_of, *metrics)
        .select(F.col("line").alias("value"), F.col("workload").alias("workload_key"))
        .write.mode("append")
        .partitionBy("workload_key")
        .text(path)
    )


def state_snapshot(units: DataFrame, version: int, as_of: Column) -> DataFrame:
    """Rows of one state version, stamped."""
    return units.withColumn("updated_at", iso_text(as_of)).withColumn("version", F.lit(version).cast("bigint"))


class AlreadyCommitted(RuntimeError):
    """The version is committed; its readers must not lose it."""


def write_state(units: DataFrame, batches: DataFrame, root: str, version: int, as_of: Column) -> None:
    """Write a state version as two tables, then commit it.

    Readers see the highest committed version only, so an interrupted write
    stays invisible and the version before it intact. A committed version is never written again; writers that
    may run at the same time use ``versions.Versions`` instead, which tells who was first.
    """
    spark = units.sparkSession
    if version in committed_versions(spark, root):
        raise AlreadyCommitted(f"version {version} of {root}")
    state_snapshot(units, version, as_of).write.mode("overwrite").parquet(f"{root}/units/v={version}")
    state_snapshot(batches, version, as_of).write.mode("overwrite").parquet(f"{root}/batches/v={version}")
    commit = spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
    commit.coalesce(1).write.mode("append").parquet(f"{root}/commits")


def committed_versions(spark: SparkSession, root: str) -> set[int]:
    """Numbers of the committed versions (one row each)."""
    try:
        return {r.version for r in spark.read.parquet(f"{root}/commits").collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def read_state(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Units and batches of the highest committed version."""
    version = spark.read.parquet(f"{root}/commits").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/units/v={version}"), spark.read.parquet(f"{root}/batches/v={version}")


#: Rules that share a file; a bucket with more is written by several tasks.
RULES_PER_FILE = 100_000


def rule_writes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per bucket: rules to write, and ``delete`` instead of ``put`` when none remain."""
    kept = after.groupBy("bucket").agg(F.count("*").alias("rules"))
    return (
        before.select("bucket")
        .union(after.select("bucket"))
        .distinct()
        .join(kept, "bucket", "left")
        .select(
            "bucket",
            F.coalesce("rules", F.lit(0)).cast("bigint").alias("rules"),
            F.when(F.col("rules").isNull(), "delete").otherwise("put").alias("action"),
        )
    )


def write_rules(before: DataFrame, after: DataFrame, path: str) -> None:
    """Replace the rules of every touched bucket; an emptied one keeps a row without position."""
    emptied = rule_writes(before, after).where(F.col("action") == "delete").select("bucket")
    rows = after.unionByName(emptied, allowMissingColumns=True)
    (
        rows.repartition("bucket", F.floor(F.col("pos") / RULES_PER_FILE))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Current rules of all buckets."""
    return spark.read.parquet(path).where(F.col("pos").isNotNull())


def rule_store(spark: SparkSession, root: str, *, settle: float = 1.0) -> Versions:
    """Rule sets in versions, for several writers: buckets that two of them write at once are a conflict."""
    return Versions(spark, root, "bucket string, pos int, id string, status string, prefix string, days int, extra string", "bucket", settle)


def state_store(spark: SparkSession, root: str, columns: str, *, settle: float = 1.0) -> Versions:
    """Unit states in versions, for several writers: batches that two of them write at once are a conflict."""
    return Versions(spark, root, columns, "batch_id", settle)


def write_archive(archived: DataFrame, path: str) -> None:
    """Add the units of ``units.split_archived`` to the archive.

    Files hold ranges of archive names in their order, so their number follows the rows and not the names, and a reader of one archive
    passes over the files and row groups without it. A large archive is spread over several files by a hash of its units.
    """
    place = ["archive_name", F.xxhash64("unit_key")]
    archived.repartitionByRange(*place).sortWithinPartitions("archive_name").write.mode("append").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All archived units with their archive's name."""
    return spark.read.parquet(path)


def write_documents(documents: DataFrame, path: str, column: str = "document") -> None:
    """Write JSON documents, one per line."""
    documents.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_markers(markers: DataFrame, path: str) -> None:
    """Append completion markers; readers keep the latest per key."""
    markers.write.mode("append").parquet(path)
