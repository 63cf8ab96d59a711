"""The zombie sweep as a report: who would be cleaned up, and with what outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators import cleanup, fleet


def sweep(
    instances: DataFrame,
    units: DataFrame,
    destroy_log: DataFrame,
    *scopes: str,
    owned: DataFrame | None = None,
    verification: DataFrame | None = None,
    provider: str = C.PROVIDERS[0],
    credentials: str = "available",
) -> DataFrame:
    """Outcome and severity of every in-scope instance that no live unit tracks.

    Ownership is taken from ``verification`` (``instance_id, verification``) if
    given, from a ``verification`` column of the instances if there is one, and
    else checked on the instance's own image. Of several destroy runs of an
    instance the latest by ``run_at`` counts, so an instance has one outcome.
    """
    candidates = fleet.zombies(fleet.scope_filter(instances, *scopes), units)
    if verification is None and "verification" in candidates.columns:
        judged = candidates
    elif verification is None:
        judged = fleet.with_ownership(candidates, owned).withColumn(
            "verification", F.when(F.lit(owned is None), "disabled").when(F.col("owned"), "owned").otherwise("refused")
        )
    else:
        judged = candidates.join(verification.select("instance_id", "verification"), "instance_id", "left").withColumn(
            "verification", F.coalesce("verification", F.lit("refused"))
        )
    last = cleanup.latest_runs(destroy_log) if "run_at" in destroy_log.columns else destroy_log
    runs = cleanup.destroy_verdict(last).withColumnRenamed("verdict", "destroy_verdict")
    outcomes = cleanup.dispatch(judged.join(runs, "instance_id", "left"), provider=provider, credentials=credentials)
    return outcomes.withColumn("severity", cleanup.severity(F.col("verdict"), F.col("refusal")))


def sweep_totals(outcomes: DataFrame) -> DataFrame:
    """Totals of a sweep."""
    return cleanup.cleanup_totals(outcomes)
