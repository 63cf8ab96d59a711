"""Poll decisions over probe and marker tables, shared with the streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import constants as C
from fleetlens.functions import json_values as J
from fleetlens.operators.units import budget_status


def event_time(df: DataFrame, name: str) -> Column:
    """The time column as a timestamp; left untouched when it is one, so a watermark on it holds."""
    column = F.col(name)
    return column if isinstance(df.schema[name].dataType, T.TimestampType) else column.cast("timestamp")


ANSWER = ("complete", "worker_dead", "log_tail")


def snapshot(probe: Column) -> Column:
    """Struct ``complete, worker_dead, log_tail`` of a VARIANT probe answer; defaults when it is no object."""
    return _normalised(J.fields(probe, *ANSWER))


def _normalised(answer: Column) -> Column:
    return F.struct(
        J.truthy(answer["complete"]).alias("complete"),
        J.truthy(answer["worker_dead"]).alias("worker_dead"),
        J.string_or_empty(answer["log_tail"]).alias("log_tail"),
    )


def with_snapshot(probes: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``_probe``, the snapshot of the JSON text in ``raw``; NULL where the text is NULL."""
    parsed = probes.withColumn("_answer", J.fields(J.parse(F.col(raw)), *ANSWER))
    once = J.computed_once(parsed, {"_snapshot": _normalised(F.col("_answer"))}, keep=tuple(probes.columns))
    return once.withColumn("_probe", F.when(F.col(raw).isNotNull(), F.col("_snapshot"))).drop("_snapshot")


def unit_action(marked: Column, probe: Column, marked_again: Column) -> Column:
    """Struct ``action, cause, detail``: ``complete, preempt`` or ``continue``.

    ``marked`` and ``marked_again`` are the marker reads before and after the
    probe, NULL when the read failed; ``probe`` is a snapshot, NULL when the
    probe failed. Only a dead worker whose second read says "no marker" is lost.
    """
    dead = probe["worker_dead"] & ~probe["complete"]
    lost = dead & ~marked_again
    action = (
        F.when(F.coalesce(marked, F.lit(False)), "complete")
        .when(probe.isNull(), "continue")
        .when(probe["complete"], "complete")
        .when(dead & marked_again, "complete")
        .when(lost, "preempt")
        .otherwise("continue")
    )
    return F.struct(
        action.alias("action"),
        F.when(action == "preempt", "worker_died").alias("cause"),
        F.when(action == "preempt", probe["log_tail"]).alias("detail"),
    )


def unit_actions(probes: DataFrame, markers: DataFrame, *, recheck_seconds: int = 0) -> DataFrame:
    """Action of every probed unit from its latest probe and its markers.

    ``probes`` has ``unit_key, ts, event_id, raw``; ``markers`` has ``unit_key,
    marker_ts``. A marker up to ``recheck_seconds`` after the probe still counts
    as the second read.
    """
    last = F.max(F.struct("ts", "event_id", "raw")).alias("_last")
    latest = probes.groupBy("unit_key").agg(last).select("unit_key", "_last.ts", F.col("_last.raw").alias("_raw"))
    first_mark = markers.groupBy("unit_key").agg(F.min("marker_ts").alias("_mark"))
    joined = with_snapshot(latest.join(first_mark, "unit_key", "left"), "_raw")
    marked = F.coalesce(F.col("_mark") <= F.col("ts"), F.lit(False))
    again = F.coalesce(F.col("_mark") <= F.col("ts") + F.make_interval(secs=F.lit(recheck_seconds)), F.lit(False))
    return joined.withColumn("_a", unit_action(marked, F.col("_probe"), again)).select("unit_key", "ts", "_a.*")


def follows_within(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int, *, strict: bool = False
) -> DataFrame:
    """Add ``followed``: a right row of the key lies at or after the left row, at most ``seconds`` later.

    Time is cut into cells of that length, so a match lies in the left row's
    cell or the next one. Each side cell keeps only its last and first time;
    no pair of rows is formed, however many rows a key has.
    """
    def cell(ts: str) -> Column:
        return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))

    per_cell = right.groupBy(key, cell(right_ts).alias("_cell")).agg(
        F.max(right_ts).alias("_last"), F.min(right_ts).alias("_first")
    )
    same = per_cell.select(key, "_cell", "_last", F.lit(None).cast(per_cell.schema["_first"].dataType).alias("_next"))
    following = per_cell.select(
        key, (F.col("_cell") - 1).alias("_cell"), F.lit(None).cast(per_cell.schema["_last"].dataType).alias("_last"), F.col("_first").alias("_next")
    )
    reach = same.unionByName(following).groupBy(key, "_cell").agg(F.max("_last").alias("_last"), F.min("_next").alias("_next"))
    here = F.col("_last") > F.col(left_ts) if strict else F.col("_last") >= F.col(left_ts)
    limit = F.unix_micros(F.col(left_ts).cast("timestamp")) + seconds * 1_000_000
    soon = F.unix_micros(F.col("_next").cast("timestamp")) <= limit
    return (
        left.withColumn("_cell", cell(left_ts))
        .join(reach, [key, "_cell"], "left")
        .withColumn("followed", F.coalesce(here, F.lit(False)) | F.coalesce(soon, F.lit(False)))
        .drop("_cell", "_last", "_next")
    )


def dead_recheck(probes: DataFrame, markers: DataFrame, *, wait_seconds: int) -> DataFrame:
    """Every dead probe with its final action: a marker within the wait completes it, else preempt."""
    dead = with_snapshot(probes).where(F.col("_probe.worker_dead") & ~F.col("_probe.complete"))
    checked = follows_within(dead, markers, "unit_key", "ts", "marker_ts", wait_seconds)
    return checked.select(
        "event_id",
        "unit_key",
        "ts",
        F.when(F.col("followed"), "complete").otherwise("preempt").alias("action"),
        F.when(~F.col("followed"), F.col("_probe.log_tail")).alias("detail"),
    )


def stuck_units(events: DataFrame, *, timeout_seconds: int = C.BOOT_TIMEOUT_SECONDS, event: str = "deployed") -> DataFrame:
    """Deployments of a unit that nothing followed within the timeout.

    Events at the same instant as the deployment do not count as progress.
    """
    started = events.where(F.col("event") == event).select("event_id", "unit_key", "ts")
    return (
        follows_within(started, events, "unit_key", "ts", "ts", timeout_seconds, strict=True)
        .where(~F.col("followed"))
        .drop("followed")
        .withColumn("reason", F.lit(f"timed out after {timeout_seconds} seconds"))
    )


def spend_windows(spend: DataFrame, ceiling: float, *, width: str = "1 day") -> DataFrame:
    """Spend per batch and time window, the running total and its budget status."""
    amount = F.sum(F.col("amount").cast("decimal(18,6)")).alias("_amount")
    windows = spend.groupBy("batch_id", F.window(event_time(spend, "ts"), width).alias("_w")).agg(amount)
    ordered = Window.partitionBy("batch_id").orderBy("_start")
    total = F.sum("_amount").over(ordered).cast("double")
    return (
        windows.withColumn("_start", F.col("_w.start"))
        .withColumn("total", total)
        .select(
            "batch_id",
            F.unix_seconds("_start").alias("window_start"),
            F.col("_amount").cast("double").alias("spent"),
            "total",
            budget_status(F.col("total"), F.lit(ceiling)).alias("status"),
        )
    )


#: Keys of progress: a shard of a batch.
PROGRESS = ("batch_id", "shard_id")


def marker_progress(markers: DataFrame, by: Sequence[str] = PROGRESS) -> DataFrame:
    """Distinct completed units per shard and batch."""
    distinct = markers.select(*by, "unit_key").distinct()
    return distinct.groupBy(*by).agg(F.count("*").alias("completed"))


def cycle_summary(actions: DataFrame, *, width: str = "1 hour") -> DataFrame:
    """Per poll cycle: completed and preempted units, and whether anything moved."""
    done, lost = F.col("action") == "complete", F.col("action") == "preempt"
    return (
        actions.groupBy(F.window(event_time(actions, "ts"), width).alias("_w"))
        .agg(F.count_if(done).alias("terminal"), F.count_if(lost).alias("preempted"))
        .select(
            F.unix_seconds("_w.start").alias("cycle_start"),
            "terminal",
            "preempted",
            ((F.col("terminal") + F.col("preempted")) > 0).alias("any_progress"),
        )
    )


def probe_actions(probes: DataFrame, markers: DataFrame) -> DataFrame:
    """Action of every single probe, given whether its unit had a marker by then."""
    first_mark = markers.groupBy("unit_key").agg(F.min("marker_ts").alias("_mark"))
    joined = with_snapshot(probes).join(first_mark, "unit_key", "left")
    marked = F.coalesce(F.col("_mark") <= F.col("ts"), F.lit(False))
    return joined.withColumn("_a", unit_action(marked, F.col("_probe"), marked)).select(
        "event_id", "unit_key", "ts", "_a.*"
    )


def log_tail(lines: DataFrame, n: int = 3, *, key: str = "unit_key") -> DataFrame:
    """The last ``n`` lines per unit in order, joined with line breaks."""
    last = Window.partitionBy(key).orderBy(F.desc("line_no"))
    tail = lines.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= n)
    joined = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return tail.groupBy(key).agg(F.array_join(F.transform(joined, lambda x: x["line"]), "\n").alias("log_tail"))
