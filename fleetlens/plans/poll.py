"""One poll cycle over all live units, as a new units table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators import polling
from fleetlens.operators import units as U


def poll_cycle(
    units: DataFrame,
    probes: DataFrame,
    markers: DataFrame,
    collected: DataFrame,
    *,
    max_retries: int = C.UNIT_RETRIES,
    classify: Callable[[Column], Column] = U.always_retry,
    recheck_seconds: int = 0,
) -> DataFrame:
    """Units after a cycle: completed ones are collected, lost ones retried or failed.

    ``collected`` lists the ``unit_key`` whose results are complete. Units that
    are not active, or were not probed, stay as they are with verdict NULL.
    """
    actions = polling.unit_actions(probes, markers, recheck_seconds=recheck_seconds).select("unit_key", "action")
    results = collected.select("unit_key").distinct().withColumn("_collected", F.lit(True))
    active = U.status_class(F.col("kind"), F.col("status")) == "active"
    joined = units.join(actions, "unit_key", "left").join(results, "unit_key", "left")
    verdict = F.when(active & F.col("action").isNotNull(), U.unit_verdict(F.col("action"), F.col("_collected")))
    reason = F.lit("worker died silently")
    exhausted = F.col("retry_count") >= max_retries
    fatal = classify(reason) == "fatal"
    lost = F.col("verdict") == "preempted"
    again = lost & ~exhausted & ~fatal
    done = F.when(F.col("kind") == "job", "completed").otherwise("downloaded")
    failed = (F.col("verdict") == "failed") | (lost & ~again)
    failure = (
        F.when(F.col("verdict") == "failed", "results are incomplete")
        .when(lost & exhausted, F.concat(reason, F.lit(" (retries exhausted)")))
        .when(lost & fatal, F.concat(reason, F.lit(" (fatal)")))
        .otherwise("")
    )
    changed = {
        "status": F.when(F.col("verdict") == "completed", done)
        .when(F.coalesce(failed, F.lit(False)), "failed")
        .when(F.coalesce(again, F.lit(False)), "pending")
        .otherwise(F.col("status")),
        "instance_id": F.when(F.coalesce(again, F.lit(False)), "").otherwise(F.col("instance_id")),
        "retry_count": F.col("retry_count") + F.when(F.coalesce(failed | again, F.lit(False)), 1).otherwise(0),
        "failure_reason": failure,
    }
    return joined.withColumn("verdict", verdict).withColumns(changed).select(*units.columns, "verdict", "failure_reason")
