"""Run a caller's function over the items of shards."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORKLOAD_RESULT = "batch_id string, shard_id bigint, block bigint, exit_code int, items bigint, error string"


def run_workload(
    items: DataFrame,
    work: Callable[[pd.DataFrame], int | None],
    *,
    health: DataFrame | None = None,
    gates: DataFrame | None = None,
    block_rows: int = 10_000,
    item: str = "item_id",
) -> DataFrame:
    """Exit code per shard: 0 done, 1 unhealthy or failed, 3 gate closed.

    ``items`` has ``batch_id, shard_id`` and the item columns. ``work`` gets a
    block of a shard's items and returns an exit code (None means 0); an
    exception counts as 1 and never stops the other blocks. Any code but 0 fails
    the shard, whose code is that of its first failing block; the distinct error
    texts of all blocks are joined. A shard is cut into
    blocks of about ``block_rows`` by item hash, so a large shard runs in many
    tasks. ``health`` (``batch_id, shard_id, healthy``) is checked first, then
    ``gates`` (``batch_id, shard_id, open``); shards that fail them do not run.
    """
    keys = ["batch_id", "shard_id"]
    shards = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    gated = shards
    for table, column in ((health, "healthy"), (gates, "open")):
        if table is None:
            gated = gated.withColumn(column, F.lit(True))
        else:
            flags = table.groupBy(*keys).agg(F.min(column).alias(column))
            gated = gated.join(flags, keys, "left").withColumn(column, F.coalesce(column, F.lit(True)))
    blocks = F.ceil(F.col("_n") / block_rows)
    ready = gated.where(F.col("healthy") & F.col("open")).select(*keys, blocks.alias("_blocks"))
    cut = items.join(ready, keys).withColumn("_block", F.pmod(F.xxhash64(item), F.col("_blocks")))
    columns = list(items.columns)

    def run_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        code, error = 0, ""
        try:
            code = int(work(block[columns]) or 0)
        except Exception as exc:
            code, error = 1, f"{type(exc).__name__}: {exc}"
        return pd.DataFrame(
            {"batch_id": [key[0]], "shard_id": [key[1]], "block": [key[2]], "exit_code": [code], "items": [len(block)], "error": [error]}
        )

    ran = (
        cut.drop("_blocks")
        .groupBy(*keys, "_block")
        .applyInPandas(run_block, WORKLOAD_RESULT)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.min_by("exit_code", F.when(F.col("exit_code") != 0, F.col("block"))), F.lit(0)).alias("exit_code"),
            F.sum("items").alias("items"),
            F.array_join(F.array_sort(F.collect_set(F.nullif("error", F.lit("")))), "; ").alias("error"),
        )
    )
    refused = gated.where(~(F.col("healthy") & F.col("open"))).select(
        *keys,
        F.when(~F.col("healthy"), 1).otherwise(3).alias("exit_code"),
        F.lit(0).cast("bigint").alias("items"),
        F.when(~F.col("healthy"), "GPU unhealthy").otherwise("preflight gate closed").alias("error"),
    )
    return ran.unionByName(refused).withColumn("completed", F.col("exit_code") == 0)
