"""Capacity planning: scaling table, work split, item placement and report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import fmt, gpu
from fleetlens.operators.ordered import hashed_rank


def scaling_table(
    workloads: DataFrame,
    prices: DataFrame,
    counts: Sequence[int] = (0, 2, 4, 8, 16),
    *,
    cheapest: DataFrame | None = None,
    local_gpu_type: str = C.LOCAL_GPU,
    cost_band: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """Wall time and cost per workload and cloud GPU count.

    ``workloads`` has ``workload_id, work_hours`` and may have
    ``cloud_gpu_type``; a missing or NULL type takes the one-row ``cheapest``.
    """
    if cheapest is not None:
        picked = cheapest.select("gpu_type").scalar()
        own = F.col("cloud_gpu_type") if "cloud_gpu_type" in workloads.columns else F.lit(None).cast("string")
        workloads = workloads.withColumn("cloud_gpu_type", F.coalesce(own, picked))
    priced = workloads.join(
        prices.select(
            F.col("gpu_type").alias("cloud_gpu_type"),
            F.col("min_price_hr").alias("_lo"),
            F.col("max_price_hr").alias("_hi"),
        ),
        "cloud_gpu_type",
        "left",
    )
    low = F.coalesce("_lo", gpu.fallback_price(F.col("cloud_gpu_type")))
    high = F.coalesce("_hi", low)
    rows = priced.withColumn("cloud_gpus", F.explode(F.array(*[F.lit(int(n)) for n in counts])))
    local_speed = C.GPU_SPEED.get(local_gpu_type, C.DEFAULT_SPEED)
    effective = F.lit(local_speed) + F.col("cloud_gpus") * gpu.speed(F.col("cloud_gpu_type"))
    wall = F.col("work_hours") / effective
    cloud_hours = wall * F.col("cloud_gpus")
    return rows.select(
        "workload_id",
        "cloud_gpus",
        F.when(F.col("cloud_gpus") > 0, F.col("cloud_gpu_type")).otherwise(F.lit(local_gpu_type)).alias("cloud_gpu_type"),
        wall.alias("wall_time_hours"),
        (cloud_hours * low * F.lit(cost_band[0])).alias("cloud_cost_min"),
        (cloud_hours * high * F.lit(cost_band[1])).alias("cloud_cost_max"),
        F.when(F.col("cloud_gpus") == 0, "local only").otherwise("").alias("notes"),
        F.lit(True).alias("feasible"),
    )


def shard_sizes(total: Column, shards: Column) -> Column:
    """Sizes of ``shards`` even parts of ``total``, larger parts first."""
    base = F.floor(total / shards).cast("int")
    extra = (total - base * shards).cast("int")
    sizes = F.transform(
        F.sequence(F.lit(0), shards - 1),
        lambda i: base + F.when(i < extra, 1).otherwise(0),
    )
    return F.when(shards > 0, sizes).otherwise(F.array().cast("array<int>"))


def hybrid_split(workloads: DataFrame, *, local_gpu_type: str = C.LOCAL_GPU) -> DataFrame:
    """Split each workload between the local GPU and cloud shards.

    Needs ``total_items, cloud_gpus, cloud_gpu_type, mode`` where mode is ``L``,
    ``C``, ``H`` or empty for automatic.
    """
    total, gpus = F.col("total_items"), F.col("cloud_gpus")
    asked = F.coalesce(F.nullif("mode", F.lit("")), F.when(gpus == 0, "L").otherwise("H"))
    mode = F.when((asked == "L") | (gpus == 0), "L").otherwise(asked)
    local_speed = F.lit(C.GPU_SPEED.get(local_gpu_type, C.DEFAULT_SPEED))
    share = local_speed / (local_speed + gpus * gpu.speed(F.col("cloud_gpu_type")))
    first_cut = F.ceil(total * share).cast("int")
    hybrid_local = F.when((first_cut == total) & (total > 1), total - 1).otherwise(first_cut)
    split = workloads.withColumn("mode", mode).withColumn(
        "local_items",
        F.when(F.col("mode") == "L", total).when(F.col("mode") == "C", 0).otherwise(hybrid_local).cast("int"),
    )
    used = F.when(F.col("mode") == "L", 0).otherwise(F.col("cloud_gpus")).cast("int")
    cloud_items = (total - F.col("local_items")).cast("int")
    return (
        split.withColumn("cloud_gpus", used)
        .withColumn("cloud_items", cloud_items)
        .withColumn("items_per_shard", shard_sizes(F.col("cloud_items"), F.col("cloud_gpus")))
        .withColumn("local_gpu_type", F.lit(local_gpu_type))
    )


def assign_items(items: DataFrame, shards: int, *, batch: str = "batch_id", item: str = "item_id") -> DataFrame:
    """Place every item of a batch on one of ``shards`` even shards, larger shards first."""
    ranked = hashed_rank(items, [batch], item)
    base = F.floor(F.col("group_size") / shards)
    extra = F.col("group_size") - base * shards
    pos = F.col("rank") - 1
    wide = extra * (base + 1)
    shard = F.when(pos < wide, F.floor(pos / (base + 1))).otherwise(
        extra + F.floor((pos - wide) / F.greatest(base, F.lit(1)))
    )
    return ranked.withColumn("shard_id", shard.cast("int")).drop("rank", "group_size")


def estimate_report(
    scaling_input: DataFrame,
    prices: DataFrame,
    counts: Sequence[int] = (0, 2, 4, 8, 16),
    *,
    as_of: str,
    local_gpu_type: str = C.LOCAL_GPU,
) -> DataFrame:
    """One JSON document per workload: prices and scaling rows, rounded for display.

    The scaling rows of a workload are as many as ``counts`` and the prices as
    many as the asked GPU types, so both arrays have a fixed size.
    """
    table = scaling_table(scaling_input, prices, counts, local_gpu_type=local_gpu_type)
    row = F.struct(
        "cloud_gpus",
        "cloud_gpu_type",
        fmt.rounded(F.col("wall_time_hours"), 3).cast("double").alias("wall_time_hours"),
        fmt.hours_text(F.col("wall_time_hours")).alias("wall_time_human"),
        fmt.rounded(F.col("cloud_cost_min"), 2).cast("double").alias("cloud_cost_min"),
        fmt.rounded(F.col("cloud_cost_max"), 2).cast("double").alias("cloud_cost_max"),
        fmt.cost_text(F.col("cloud_gpus"), F.col("cloud_cost_min"), F.col("cloud_cost_max")).alias("cost_display"),
        "notes",
        "feasible",
    )
    rows = table.groupBy("workload_id").agg(F.sort_array(F.collect_list(row)).alias("scaling_table"))
    price = F.struct(
        "ord",
        "gpu_type",
        "available_count",
        fmt.rounded(F.col("min_price_hr"), 3).cast("double").alias("min_price_hr"),
        fmt.rounded(F.col("max_price_hr"), 3).cast("double").alias("max_price_hr"),
        fmt.rounded(F.col("median_price_hr"), 3).cast("double").alias("median_price_hr"),
    )
    pricing = prices.agg(
        F.transform(F.sort_array(F.collect_list(price)), lambda p: p.dropFields("ord")).alias("pricing")
    ).scalar()
    doc = F.struct(
        F.col("workload_id").cast("string").alias("workload"),
        F.concat(F.col("work_hours").cast("string"), F.lit("h of GPU work")).alias("description"),
        F.lit(0).alias("num_items"),
        F.lit(local_gpu_type).alias("local_gpu"),
        pricing.alias("pricing"),
        "scaling_table",
        F.lit(as_of).alias("timestamp"),
    )
    return (
        scaling_input.join(rows, "workload_id")
        .select("workload_id", F.to_json(doc).alias("document"))
    )
