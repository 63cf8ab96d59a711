"""Whether a shard's results are provably complete, and the code a publish run returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = ("batch_id", "shard_id")


def _entries(outputs: DataFrame, completions: DataFrame) -> DataFrame:
    """Top-level output entries without a completion marker, with ``is_dir``.

    Outputs and markers meet in one aggregate, so the file list is reduced
    before the only shuffle.
    """
    parts = F.split("rel_path", "/")
    yes, no = F.lit(True), F.lit(False)
    written = outputs.select(
        *SHARD, F.get(parts, F.lit(0)).alias("entry"), (F.size(parts) > 1).alias("is_dir"), yes.alias("_out"), no.alias("_done")
    )
    done = completions.select(*SHARD, F.col("prediction").alias("entry"), yes.alias("is_dir"), no.alias("_out"), yes.alias("_done"))
    return (
        written.unionByName(done)
        .groupBy(*SHARD, "entry", "is_dir")
        .agg(F.max("_out").alias("_out"), F.max("_done").alias("_done"))
        .where(F.col("_out") & ~F.col("_done"))
        .select(*SHARD, "entry", "is_dir")
    )


def missing_predictions(outputs: DataFrame, completions: DataFrame, shard_markers: DataFrame) -> DataFrame:
    """Top-level output entries without proof of completion.

    Directories need their own completion marker. A flat file needs the shard
    marker and shows as ``FLAT:<name>``.
    """
    marked = shard_markers.select(*SHARD, F.lit(False).alias("is_dir"))
    shown = F.when(F.col("is_dir"), F.col("entry")).otherwise(F.concat(F.lit("FLAT:"), "entry"))
    return _entries(outputs, completions).join(marked, [*SHARD, "is_dir"], "left_anti").select(*SHARD, shown.alias("entry"))


def upload_unresolved(
    shards: DataFrame, outputs: DataFrame, failures: DataFrame, completions: DataFrame, shard_markers: DataFrame
) -> DataFrame:
    """``unresolved`` per shard of ``shards``: its uploads are not provably complete.

    All evidence is tagged, united and reduced by shard in one aggregate.
    """
    tables = {
        "shard": shards,
        "failed": failures,
        "output": outputs,
        "marker": shard_markers,
        "missing": _entries(outputs, completions),
    }
    tagged = None
    for tag, table in tables.items():
        rows = table.select(*SHARD, F.lit(tag).alias("_tag"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    has = {tag: F.max(F.col("_tag") == tag).alias(f"_{tag}") for tag in tables}
    unresolved = (
        F.when(F.col("_failed"), True)
        .when(~F.col("_output") | F.col("_marker"), False)
        .otherwise(F.col("_missing"))
    )
    return tagged.groupBy(*SHARD).agg(*has.values()).where("_shard").select(*SHARD, unresolved.alias("unresolved"))


def publish_code(evidence: DataFrame, *, full: bool) -> DataFrame:
    """Return code of a publish run over evidence columns, 0 on success.

    3 files failed, 5 shard marker not written, 4 unresolved uploads, 1 exit
    code missing, 2 completion marker failed. ``full`` uploads everything first;
    otherwise only the marker of a shard is published. Jobs always upload all
    and have no shard marker.
    """
    job = F.col("kind") == "job"
    proven = ~F.col("has_outputs") | F.col("shard_marker") | ~F.col("predictions_missing")
    after_full = F.col("has_failure_rows")
    unresolved = F.when(job, after_full).otherwise(after_full if full else after_full | ~proven)
    uploads = job | F.lit(full)
    code = (
        F.when(uploads & F.col("files_failed"), 3)
        .when(~job & F.lit(full) & ~F.col("marker_written"), 5)
        .when(unresolved, 4)
        .when(~F.col("exitcode_ok"), 1)
        .when(~F.col("done_put_ok"), 2)
        .otherwise(0)
    )
    return evidence.withColumn("code", code)


def prediction_status(log: DataFrame) -> DataFrame:
    """``ok, failed`` or ``absent`` per prediction from its latest run, and whether failures stay open.

    A later success clears the failures before it; an absent run clears nothing.
    """
    order = F.struct("ts", "event_id")
    outcome = F.col("outcome")
    failed = outcome.isin("file_failed", "marker_failed")
    status = F.when(outcome == "uploaded", "ok").when(failed, "failed").otherwise("absent")
    last_failure = F.max(F.when(failed, order))
    last_success = F.max(F.when(outcome == "uploaded", order))
    last = F.max(F.struct("ts", "event_id", status.alias("status"), F.col("files_uploaded").alias("uploaded")))
    runs = log.groupBy(*SHARD, "prediction").agg(
        last.alias("_last"),
        (last_failure.isNotNull() & (last_success.isNull() | (last_failure > last_success))).alias("open_failures"),
    )
    return runs.select(*SHARD, "prediction", "_last.status", "_last.uploaded", "open_failures")


def open_failure_rows(failures: DataFrame, statuses: DataFrame, sentinel: str = "SENTINEL_WRITE_FAILED") -> DataFrame:
    """Failure rows that still block: those of predictions not cleared, and every sentinel row."""
    cleared = statuses.where((F.col("status") == "ok") & ~F.col("open_failures")).select(
        *SHARD, F.col("prediction").alias("name")
    )
    is_sentinel = F.col("name").eqNullSafe(F.lit(sentinel))
    named = failures.where(~is_sentinel).join(cleared, [*SHARD, "name"], "left_anti")
    return named.unionByName(failures.where(is_sentinel))


