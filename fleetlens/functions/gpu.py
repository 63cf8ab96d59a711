"""GPU names, speeds, CUDA versions, telemetry and memory readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import lookup, strip


def market_name(gpu_type: Column) -> Column:
    """Marketplace spelling of a canonical GPU id; unknown ids pass through."""
    named = F.create_map(*[F.lit(x) for pair in C.GPU_MARKET_NAME.items() for x in pair])
    return F.coalesce(F.try_element_at(named, gpu_type), gpu_type)


def canonical_type(name: Column) -> Column:
    """Canonical id of a marketplace GPU name; unknown names pass through."""
    typed = F.create_map(*[F.lit(x) for k, v in C.GPU_MARKET_NAME.items() for x in (v, k)])
    return F.coalesce(F.try_element_at(typed, name), name)


def speed(gpu_type: Column) -> Column:
    """Throughput relative to the 4090."""
    return lookup(gpu_type, C.GPU_SPEED, C.DEFAULT_SPEED)


def fallback_price(gpu_type: Column) -> Column:
    """Static price in $/hour."""
    return lookup(gpu_type, C.FALLBACK_PRICE, C.DEFAULT_PRICE)


def cuda_version(image: Column) -> Column:
    """CUDA ``major.minor`` an image asks for."""
    found = F.regexp_extract(image, r"cuda[:\-]([0-9]+\.[0-9]+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(C.DEFAULT_CUDA))


def version_at_least(have: Column, need: Column) -> Column:
    """Compare ``major.minor`` texts number by number."""
    def parts(v: Column) -> Column:
        return F.transform(F.split(v, r"\."), lambda p: p.cast("int"))

    return parts(have) >= parts(need)


def safe_int(text: Column) -> Column:
    """Non-negative integer reading without a sign, 0 when unreadable."""
    trimmed = strip(text)
    number = F.when(~trimmed.startswith("+"), F.greatest(trimmed.try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def ecc_count(text: Column) -> Column:
    """ECC error count; not-available and unreadable values count as 0."""
    trimmed = strip(text)
    grouped = F.regexp_extract(trimmed, r"\A[+-]?[0-9]+(?:_[0-9]+)+\z", 0)
    number = F.when(trimmed.contains("_"), F.replace(grouped, F.lit("_"), F.lit("")).try_cast("bigint")).otherwise(
        trimmed.try_cast("bigint")
    )
    return F.coalesce(number, F.lit(0).cast("bigint"))


def telemetry(csv_line: Column, *, min_memory_mib: int = 0) -> Column:
    """Struct ``temp_c, mem_mib, ecc`` of one reading; NULL when the shape is unknown."""
    parts = F.split(strip(csv_line), ",")
    two = F.struct(
        safe_int(F.get(parts, F.lit(0))).alias("temp_c"),
        F.lit(0).cast("bigint").alias("mem_mib"),
        strip(F.get(parts, F.lit(1))).alias("ecc"),
    )
    three = F.struct(
        safe_int(F.get(parts, F.lit(0))).alias("temp_c"),
        safe_int(F.get(parts, F.lit(1))).alias("mem_mib"),
        strip(F.get(parts, F.lit(2))).alias("ecc"),
    )
    reading = F.when(F.size(parts) >= 2, two)
    if min_memory_mib > 0:
        reading = F.when(F.size(parts) >= 3, three).otherwise(reading)
    return reading


def breach(reading: Column, *, min_memory_mib: int = 0, max_temp_c: int = C.MAX_TEMP_C) -> Column:
    """First limit a reading breaks: ``temp``, ``memory``, ``ecc`` or NULL when healthy."""
    too_small = F.lit(False)
    if min_memory_mib > 0:
        too_small = reading["mem_mib"] < min_memory_mib
    return (
        F.when(reading["temp_c"] > max_temp_c, "temp")
        .when(too_small, "memory")
        .when(ecc_count(reading["ecc"]) > 0, "ecc")
    )


def vram(raw: Column) -> Column:
    """Struct ``used_mib, total_mib`` from the first line; NULL when unreadable."""
    parts = F.split(F.get(F.split(strip(raw), "\n"), F.lit(0)), ",")
    used = strip(F.get(parts, F.lit(0))).try_cast("bigint")
    total = strip(F.get(parts, F.lit(1))).try_cast("bigint")
    return F.when(
        used.isNotNull() & total.isNotNull(),
        F.struct(used.alias("used_mib"), total.alias("total_mib")),
    )
