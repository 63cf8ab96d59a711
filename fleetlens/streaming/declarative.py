"""Streams built from DataFrame operations only.

Every function maps streaming DataFrames to a streaming DataFrame that the
caller starts. Time columns are ``TIMESTAMP``. The docstring names the output
mode where only one works.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators import health as H
from fleetlens.operators import polling, units

def unit_action_stream(probes: DataFrame) -> DataFrame:
    """Stateless action of each probe row ``unit_key, ts, event_id, raw, marked, marked_again``."""
    return (
        polling.with_snapshot(probes)
        .withColumn("_a", polling.unit_action(F.col("marked"), F.col("_probe"), F.col("marked_again")))
        .select("event_id", "unit_key", "ts", "_a.*")
    )


def unit_state_stream(events: DataFrame) -> DataFrame:
    """Current state per unit (update mode); one state row per unit, combined before the shuffle."""
    return units.current_state(events)


def spend_monitor_stream(spend: DataFrame, ceiling: float | Column) -> DataFrame:
    """Running spend and budget status per batch (update mode)."""
    limit = F.lit(ceiling) if isinstance(ceiling, (int, float)) else ceiling
    total = F.sum(F.col("amount").cast("decimal(18,6)")).cast("double")
    return (
        spend.groupBy("batch_id")
        .agg(total.alias("spent"), F.max("ts").alias("ts"))
        .withColumn("status", units.budget_status(F.col("spent"), limit))
    )


def spend_window_stream(spend: DataFrame, *, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Spend per batch and tumbling window."""
    return (
        spend.withWatermark("ts", delay)
        .groupBy("batch_id", F.window("ts", width))
        .agg(F.sum(F.col("amount").cast("decimal(18,6)")).cast("double").alias("spent"))
        .select("batch_id", F.col("window.start").alias("window_start"), "spent")
    )


def distinct_markers_stream(markers: DataFrame, *, by: Sequence[str] = polling.PROGRESS, delay: str = "1 hour") -> DataFrame:
    """Each marker once, however late it is written again; the state keeps one row per marker."""
    return markers.withWatermark("marker_ts", delay).dropDuplicates([*by, "unit_key"])


def progress_stream(
    markers: DataFrame, *, by: Sequence[str] = polling.PROGRESS, width: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Units completed for the first time, per shard and batch (or ``by``) and time window (append mode)."""
    return (
        distinct_markers_stream(markers, by=by, delay=delay)
        .groupBy(F.window("marker_ts", width), *by)
        .agg(F.count("*").alias("completed"))
        .select(F.col("window.start").alias("window_start"), *by, "completed")
    )


def gpu_health_stream(
    telemetry: DataFrame, *, delay: str = "1 hour", min_memory_mib: int = 0, max_temp_c: int = C.MAX_TEMP_C
) -> DataFrame:
    """The first unhealthy reading per instance to arrive, again only after ``delay`` of silence."""
    judged = H.gpu_health(telemetry, min_memory_mib=min_memory_mib, max_temp_c=max_temp_c)
    return judged.where(~F.col("healthy")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["instance_id"])


def first_unhealthy_stream(telemetry: DataFrame, *, min_memory_mib: int = 0, max_temp_c: int = C.MAX_TEMP_C) -> DataFrame:
    """The first unhealthy reading per instance by time (update mode): a row again when an earlier one turns up."""
    return H.first_unhealthy(H.gpu_health(telemetry, min_memory_mib=min_memory_mib, max_temp_c=max_temp_c))


def cycle_summary_stream(actions: DataFrame, *, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Terminal and preempted units per poll cycle."""
    return polling.cycle_summary(actions.withWatermark("ts", delay), width=width)
