"""GPU health from telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import gpu
from fleetlens.functions.json_values import computed_once


def gpu_health(
    telemetry: DataFrame, *, line: str = "csv_line", min_memory_mib: int = 0, max_temp_c: int = C.MAX_TEMP_C
) -> DataFrame:
    """Add ``breach`` (first broken limit, NULL when fine) and ``healthy``; an unreadable line is healthy."""
    reading = gpu.telemetry(F.col(line), min_memory_mib=min_memory_mib)
    limit = gpu.breach(F.col("_reading"), min_memory_mib=min_memory_mib, max_temp_c=max_temp_c)
    judged = computed_once(
        telemetry.withColumn("_reading", reading), {"breach": limit}, keep=tuple(telemetry.columns)
    )
    return judged.withColumn("healthy", F.col("breach").isNull())


def first_unhealthy(health: DataFrame) -> DataFrame:
    """The first unhealthy reading per instance."""
    first = F.min(F.struct("ts", "event_id", "breach")).alias("_first")
    return health.where(~F.col("healthy")).groupBy("instance_id").agg(first).select("instance_id", "_first.*")


def vram_gate(readings: DataFrame, *, raw: str = "raw", min_mib: int = C.MIN_VRAM_MIB) -> DataFrame:
    """Add ``total_mib`` and ``gate``: ``ok``, ``too low`` or ``unreadable``."""
    total = gpu.vram(F.col(raw))["total_mib"]
    gate = F.when(total.isNull(), "unreadable").when(total >= min_mib, "ok").otherwise("too low")
    return readings.withColumn("total_mib", total).withColumn("gate", gate)
