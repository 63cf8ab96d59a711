"""From raw listing records to cleanup outcomes in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetlens.operators import fleet
from fleetlens.plans.sweep import sweep


def cleanup_report(
    normalized: DataFrame,
    units: DataFrame,
    destroy_log: DataFrame,
    *scopes: str,
    owned: DataFrame | None = None,
    credentials: str = "available",
) -> DataFrame:
    """Outcome and severity of every untracked, in-scope instance of the sound listings.

    ``normalized`` comes from ``fleet.normalize_records``. Ownership is verified
    against the same listings.
    """
    instances = fleet.judged_instances(normalized, owned)
    return sweep(instances, units, destroy_log, *scopes, credentials=credentials)
