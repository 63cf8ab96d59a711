"""From offers to a scaling table in one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from fleetlens import constants as C
from fleetlens.operators import offers as market
from fleetlens.operators import planning


def estimate(
    offers: DataFrame,
    workloads: DataFrame,
    counts: Sequence[int] = (0, 2, 4, 8, 16),
    *,
    gpu_types: Sequence[str] = C.GPU_TYPES,
    image: str | None = None,
) -> DataFrame:
    """Scaling rows for every workload at market prices; the cheapest type where none is asked.

    ``image`` is the workload's container image; only offers that run its CUDA version count then.
    """
    prices = market.price_summary(offers, gpu_types, image=image)
    return planning.scaling_table(workloads, prices, counts, cheapest=market.cheapest_type(prices))
