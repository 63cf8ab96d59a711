"""Registration of queries next to their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, oracle: str | None = None) -> Callable:
    """Register ``fn(views) -> DataFrame`` under ``name``.

    ``views`` names the fixture views the oracle text reads; it must open with
    SELECT or continue the CTE list with a leading comma.
    """

    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views)
        return fn

    return register
