"""Marketplace offers: quality filter, price summary, ranking and assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import gpu
from fleetlens.operators.ordered import Running, exact_median, running
from fleetlens.session import stored

OFFER_ORDER = ("dph_total", "offer_id", "machine_id")
#: Slices per dollar of the machine ranks, and first characters of a key that make a slice of the unit ranks.
PRICE_SLICES, KEY_SLICE = 10_000, 4


def quality_filter(
    offers: DataFrame,
    gpu_types: Sequence[str] = C.GPU_TYPES,
    *,
    cuda: str = C.DEFAULT_CUDA,
    image: str | None = None,
    max_cost_per_hour: float = C.MAX_COST_PER_HOUR,
    min_network_mbps: float = C.MIN_NETWORK_MBPS,
    min_reliability: float = C.MIN_RELIABILITY,
) -> DataFrame:
    """Offers that satisfy the market query for the wanted GPU types.

    With ``image`` the needed CUDA version is the one its name tells.
    """
    needed = F.lit(float(cuda)) if image is None else gpu.cuda_version(F.lit(image)).cast("double")
    names = [C.GPU_MARKET_NAME.get(t, t) for t in gpu_types]
    return offers.where(
        F.col("gpu_name").isin(names)
        & (F.col("num_gpus") == 1)
        & F.col("rentable")
        & (F.col("cuda_max_good") >= needed)
        & (F.col("dph_total") <= max_cost_per_hour)
        & (F.col("inet_down") >= min_network_mbps)
        & (F.col("reliability") >= min_reliability)
    ).withColumn("gpu_type", gpu.canonical_type(F.col("gpu_name")))


def cheapest_per_type(offers: DataFrame, k: int = C.OFFERS_PER_QUERY) -> DataFrame:
    """The ``k`` cheapest offers of each GPU type, with their rank."""
    ordered = Window.partitionBy("gpu_type").orderBy(*OFFER_ORDER)
    return offers.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def cheapest_overall(offers: DataFrame, k: int = C.OFFERS_PER_QUERY) -> DataFrame:
    """The ``k`` cheapest offers of the market."""
    return offers.orderBy(*OFFER_ORDER).limit(k)


def wanted_types(offers: DataFrame, gpu_types: Sequence[str]) -> DataFrame:
    """One row per asked GPU type with its position in the request."""
    rows = [(i, t) for i, t in enumerate(gpu_types)]
    return offers.sparkSession.createDataFrame(rows, "ord int, gpu_type string")


def with_fallback(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """Every asked GPU type with its live price, or the static one and count 0."""
    static = gpu.fallback_price(F.col("gpu_type"))
    return wanted.join(live, "gpu_type", "left").select(
        *wanted.columns,
        F.coalesce("available_count", F.lit(0)).cast("bigint").alias("available_count"),
        *[F.coalesce(c, static).alias(c) for c in ("min_price_hr", "max_price_hr", "median_price_hr")],
    )


def price_summary(
    offers: DataFrame,
    gpu_types: Sequence[str] = C.GPU_TYPES,
    **thresholds: object,
) -> DataFrame:
    """Price statistics per asked GPU type over the whole market."""
    passing = quality_filter(offers, gpu_types, **thresholds)
    priced = passing.where(F.col("dph_total").isNotNull() & (F.col("dph_total") != 0))
    live = exact_median(priced, ["gpu_type"], "dph_total").select(
        "gpu_type",
        F.col("count").alias("available_count"),
        F.col("min").alias("min_price_hr"),
        F.col("max").alias("max_price_hr"),
        F.col("median").alias("median_price_hr"),
    )
    return with_fallback(wanted_types(offers, gpu_types), live)


def cheapest_type(prices: DataFrame) -> DataFrame:
    """One row: the GPU type with the lowest median, first asked on ties."""
    return prices.agg(
        F.coalesce(
            F.min_by("gpu_type", F.struct("median_price_hr", "ord")), F.lit(C.LOCAL_GPU)
        ).alias("gpu_type")
    )


def offers_from_json(raw: Column) -> Column:
    """Array of offer structs from one market answer; anything but an array gives none."""
    schema = (
        "array<struct<id:bigint,machine_id:string,gpu_name:string,num_gpus:int,rentable:boolean,"
        "cuda_max_good:double,dph_total:double,inet_down:double,reliability:double>>"
    )
    is_array = raw.rlike(r"\A\s*\[") & F.try_parse_json(raw).isNotNull()
    return F.when(is_array, F.from_json(raw, schema))


def parse_offers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Explode market answers into offer rows."""
    return (
        answers.withColumn("_offer", F.explode(offers_from_json(F.col(raw))))
        .select("*", "_offer.*")
        .drop(raw, "_offer")
        .withColumnRenamed("id", "offer_id")
        .withColumn("machine_id", F.coalesce("machine_id", F.lit("")))
    )


def assign(units: DataFrame, offers: DataFrame, *, key: str = "unit_key") -> DataFrame:
    """Give each deployable unit an offer of its GPU type, cheapest machine first.

    The n-th unit by ``key`` gets the n-th distinct machine by the machine's best
    offer. An offer without a machine id can serve any number of units, so the
    cheapest such offer ends the list and takes all units that are left. ``units``
    and ``offers`` carry ``gpu_type``. Both ranks are cut into slices (of price, of
    the key's first characters), so that no task orders a whole GPU type.
    """
    best = F.min(F.struct(*OFFER_ORDER)).alias("_best")
    machines = stored(offers.withColumn("machine_id", F.coalesce("machine_id", F.lit(""))).groupBy("gpu_type", "machine_id").agg(best), "machines")
    open_offer = machines.where(F.col("machine_id") == "").select("gpu_type", F.col("_best").alias("_open"))
    closed = (
        machines.where(F.col("machine_id") != "")
        .join(open_offer, "gpu_type", "left")
        .where(F.col("_open").isNull() | (F.col("_best") < F.col("_open")))
        .select("gpu_type", "_best.*")
    )
    one = [Running("_slot", "sum", F.lit(1))]
    slots = running(
        closed, ["gpu_type"], "dph_total", OFFER_ORDER[1:], one, slice_by=F.floor(F.col("dph_total") * PRICE_SLICES)
    ).select("gpu_type", "_slot", "offer_id", "machine_id")
    numbered = running(units, ["gpu_type"], key, [], one, slice_by=F.substring(F.col(key).cast("string"), 1, KEY_SLICE))
    known = machines.select("gpu_type").distinct().withColumn("_listed", F.lit(True))
    placed = (
        numbered.join(slots, ["gpu_type", "_slot"], "left")
        .join(open_offer, "gpu_type", "left")
        .join(known, "gpu_type", "left")
    )
    offer = F.coalesce("offer_id", "_open.offer_id")
    return placed.select(
        *units.columns,
        offer.alias("offer_id"),
        F.when(offer.isNotNull(), F.coalesce("machine_id", F.lit(""))).alias("machine_id"),
        F.when(offer.isNotNull(), "")
        .when(F.col("_listed").isNull(), "No GPU offers available")
        .otherwise("no unclaimed offer")
        .alias("error"),
    )
