"""The zombie sweep over a stream of listing snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from fleetlens.session import checkpoint_root


def start_sweep(
    listings: DataFrame,
    report: Callable[[DataFrame], DataFrame],
    path: str,
    *,
    only: Column | None = None,
    checkpoint: str | None = None,
    query_name: str = "sweep",
) -> StreamingQuery:
    """Run ``report`` on every micro-batch of listings and write its rows.

    ``report`` maps listings to outcome rows, usually ``plans.sweep.sweep``
    with the tracked units bound. Which listings are swept is said by ``only``, a
    condition on their rows such as a cycle number, and never by the micro-batch
    they come in. Each run overwrites its own folder, so a repeated micro-batch
    leaves no duplicate rows.
    """
    chosen = listings if only is None else listings.where(only)

    def run(batch: DataFrame, number: int) -> None:
        report(batch).write.mode("overwrite").parquet(f"{path}/run={number}")

    folder = checkpoint or f"{checkpoint_root(listings.sparkSession)}/{query_name}"
    return (
        chosen.writeStream.queryName(query_name)
        .option("checkpointLocation", folder)
        .trigger(availableNow=True)
        .foreachBatch(run)
        .start()
    )
