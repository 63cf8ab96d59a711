"""Ordered computations that hold when one key owns much of the data.

A window over a key alone puts the whole key into one task. Here the order
range of every key is cut into slices first: slices are aggregated with
map-side combine, a window runs over the few slice rows of a key, and the fine
window runs inside one slice. All cuts are functions of the row, so a rerun
after a lost executor gives the same slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import stored

DAY = 86_400
#: Rows from which a slice is cut again, parts it is cut into at most, and slices that are cut at most.
#: The slices cut are the largest ones, so a slice left whole holds less than 1 / HEAVY_SLICES of all rows.
HEAVY_ROWS, HEAVY_PARTS, HEAVY_SLICES = 200_000, 512, 200
#: Sampled rows per cut.
_PER_CUT = 8


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is ``sum`` or ``max``; own row in or out."""

    name: str
    kind: str
    value: Column
    include_current: bool = True


def _combine(kind: str, left: Column, right: Column) -> Column:
    if kind == "max":
        return F.greatest(left, right)
    return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))


@dataclass(frozen=True)
class Sliced:
    """``rows`` with ``_group`` (keys, ``_slice``, ``_part``), and a stored row of ``totals`` per group with the same fields."""

    rows: DataFrame
    totals: DataFrame


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: Sequence[Column], *, rows: int | None = None) -> Sliced:
    """Cut the slices of ``df`` (column ``_slice``) again where they are heavy, and fold each group.

    The folds of all slices are computed first and stored, so ``df`` is read once for them and once for its rows, however
    often the totals are used. Only if a slice has more than ``rows`` rows, a sample of its distinct places
    in the order, each with its count, gives at most ``HEAVY_PARTS`` cuts of it, and the cuts (at most
    ``HEAVY_SLICES * HEAVY_PARTS`` tuples) are broadcast. A burst of equal rows is one place of the sample, however many rows it has.
    NULL is a key and a slice like others: groups are structs, whose NULL fields are equal.
    """
    limit = HEAVY_ROWS if rows is None else rows
    names = [*keys, "_slice"]
    whole = df.withColumn("_whole", F.struct(*names))
    totals = stored(whole.groupBy("_whole").agg(F.count("*").alias("_rows"), *folds), "slices")
    heavy = totals.where(F.col("_rows") > limit)
    if heavy.isEmpty():
        plain = whole.withColumn("_part", F.lit(0))
        totals = totals.withColumn("_part", F.lit(0))
    else:
        heavy = stored(heavy.select("_whole", "_rows").orderBy(F.desc("_rows"), "_whole").limit(HEAVY_SLICES), "heavy-slices")
        cuts = F.broadcast(stored(_cuts(whole.join(F.broadcast(heavy), "_whole"), order, limit), "cuts"))
        part = F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c < F.struct(*order)))
        plain = whole.join(cuts, "_whole", "left").withColumn("_part", part).drop("_cuts")
        inside = plain.join(F.broadcast(heavy.select("_whole")), "_whole", "left_semi").groupBy("_whole", "_part").agg(F.count("*").alias("_rows"), *folds)
        others = totals.join(F.broadcast(heavy.select("_whole")), "_whole", "left_anti").withColumn("_part", F.lit(0))
        totals = others.unionByName(stored(inside, "heavy-totals"))
    group = F.struct(*[F.col("_whole")[n].alias(n) for n in names], "_part")
    return Sliced(plain.withColumn("_group", group).drop("_whole", "_slice", "_part"), totals.withColumn("_group", group).drop("_whole", "_part"))


def _cuts(heavy: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """Cuts of each heavy slice at quantiles of its places; a place counts by its rows."""
    parts = F.least(F.ceil(F.col("_rows") / limit), F.lit(HEAVY_PARTS))
    every = F.greatest(F.floor(F.col("_rows") / (parts * _PER_CUT)), F.lit(1))
    places = heavy.groupBy("_whole", "_rows", F.struct(*order).alias("_place")).agg(F.count("*").alias("_n"))
    # a place with as many rows as stand for a sampled one is always taken, with its weight
    seen = places.where((F.col("_n") >= every) | (F.pmod(F.xxhash64("_place"), every) == 0)).withColumn("_weight", F.greatest(F.lit(1), F.floor(F.col("_n") / every)))
    upto = Window.partitionBy("_whole").orderBy("_place")
    cell = lambda weight: F.floor(weight / _PER_CUT)
    ends = seen.withColumn("_end", F.sum("_weight").over(upto)).where(cell(F.col("_end")) > cell(F.col("_end") - F.col("_weight")))
    return ends.groupBy("_whole").agg(F.sort_array(F.collect_list("_place")).alias("_cuts"))


def _of_group(keys: Sequence[str]) -> list[Column]:
    return [F.col("_group")[k] for k in keys]


def running(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    specs: Sequence[Running],
    *,
    slice_seconds: int = DAY,
    slice_by: Column | None = None,
    heavy_rows: int | None = None,
) -> DataFrame:
    """Add running values per key, ordered by ``ts`` then ``ties``, NULLs first; rows that are equal there get their values in any order.

    NULL is a key like others. The slice window holds one row per key and time
    slice, so its size depends on the time span and not on the row count. For a
    numeric order give ``slice_by``, a non-decreasing function of it. The totals of the slices are computed at once (``sliced``),
    the rows when the result is used.
    """
    fold = {"sum": F.sum, "max": F.max}
    if slice_by is None:
        slice_by = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / slice_seconds)
    cut = df.withColumn("_slice", slice_by).select("*", *[s.value.alias(f"_v_{s.name}") for s in specs])
    parts = sliced(cut, keys, [ts, *ties], [fold[s.kind](f"_v_{s.name}").alias(f"_t_{s.name}") for s in specs], rows=heavy_rows)
    before = Window.partitionBy(*_of_group(keys)).orderBy(*_of_group(["_slice", "_part"])).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.totals.select("_group", *[fold[s.kind](f"_t_{s.name}").over(before).alias(f"_b_{s.name}") for s in specs])
    inner = Window.partitionBy("_group").orderBy(ts, *ties)
    scanned = parts.rows.join(bases, "_group", "left")
    out = {}
    for s in specs:
        frame = inner.rowsBetween(Window.unboundedPreceding, 0 if s.include_current else -1)
        out[s.name] = _combine(s.kind, F.col(f"_b_{s.name}"), fold[s.kind](f"_v_{s.name}").over(frame))
    return scanned.withColumns(out).drop("_group", *[f"_v_{s.name}" for s in specs], *[f"_b_{s.name}" for s in specs])


def hash_slice(value: Column) -> Column:
    """One of 4096 even slices, from the text's md5; NULL has a slice of its own before them."""
    return F.coalesce(F.substring(F.md5(value.cast("string")), 1, 3), F.lit(""))


def hashed_rank(df: DataFrame, keys: Sequence[str], ident: str, name: str = "rank") -> DataFrame:
    """Add a 1-based rank per key in the order (hash slice, ident), and the key's row count.

    The slices are even whatever the key sizes are, so a key with most of the
    rows is still ranked by 4096 tasks, and by more where a slice is heavy. NULL is a key and an ident like others.
    """
    parts = sliced(df.withColumn("_slice", hash_slice(F.col(ident))), keys, [ident], [])
    of_key = Window.partitionBy(*_of_group(keys))
    ordered = of_key.orderBy(*_of_group(["_slice", "_part"])).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.totals.select(
        "_group", F.coalesce(F.sum("_rows").over(ordered), F.lit(0)).alias("_base"), F.sum("_rows").over(of_key).alias("group_size")
    )
    inner = Window.partitionBy("_group").orderBy(ident)
    ranked = parts.rows.join(bases, "_group").withColumn(name, F.col("_base") + F.row_number().over(inner))
    return ranked.drop("_group", "_base")


def positions(df: DataFrame, keys: Sequence[str], order: str, *, ties: Sequence[str] = (), slice_size: int = 4096, name: str = "position") -> DataFrame:
    """Add a 1-based position per key in the order of the number ``order``, by slices of its value."""
    placed = running(df, keys, order, list(ties), [Running(name, "sum", F.lit(1))], slice_by=F.floor(F.col(order) / slice_size))
    return placed.withColumn(name, F.col(name).cast("bigint"))


def followed(df: DataFrame, value: str, name: str, *, slices: int = 4096) -> DataFrame:
    """Add the number ``value`` of the next row in its order over all rows, NULLs first; NULL behind the last row.

    The order is cut into ``slices`` of equal width; the next row of the last one of a slice is the first one of the next slice.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    width = 1.0 if low is None else max(1.0, (high - low) / slices)
    parts = sliced(df.withColumn("_slice", F.floor(F.col(value).cast("double") / width)), [], [value], [F.min(value).alias("_first")])
    firsts = parts.totals.select("_group", F.lead("_first").over(Window.partitionBy().orderBy(*_of_group(["_slice", "_part"]))).alias("_base"))
    inner = Window.partitionBy("_group").orderBy(value)
    last = F.lead(F.lit(True)).over(inner).isNull()
    following = F.when(last, F.col("_base")).otherwise(F.lead(value).over(inner))
    return parts.rows.join(firsts, "_group").withColumn(name, following).drop("_group", "_base")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, *, cells: int = 256) -> DataFrame:
    """Exact ``count, min, max, median`` of a double per key.

    Equal values are counted before any shuffle. Approximate quantiles of the distinct values cut them into
    ``cells`` of about equal size, so neither outliers nor a wide range matter. The counts of the cells then tell which
    of them hold the middle ranks, and only the values of those cells are ordered.
    """
    present = F.col(value).isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    counted = df.where(present).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    span = counted.groupBy(*keys).agg(
        F.percentile_approx(value, [i / cells for i in range(1, cells)], 20 * cells).alias("_cuts"),
        F.sum("_n").alias("_total"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    # The explicit test keeps all readers of the counts on one shuffle: the join below would
    # otherwise add it to one side only.
    placed = (
        counted.join(span, list(keys))
        .withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
        .where(F.col("_cell").isNotNull())
        .drop("_cuts")
    )
    per_key = Window.partitionBy(*keys)
    lower, upper = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    middle = (
        placed.groupBy(*keys, "_cell")
        .agg(F.sum("_n").alias("_cn"), F.max("_total").alias("_total"))
        .withColumn("_end", F.sum("_cn").over(per_key.orderBy("_cell")))
        .withColumn("_start", F.col("_end") - F.col("_cn"))
        .where((F.col("_start") <= upper) & (F.col("_end") > lower))
        .select(*keys, "_cell", "_start")
    )
    in_cell = Window.partitionBy(*keys, "_cell").orderBy(value)
    return (
        placed.join(middle, [*keys, "_cell"])
        .withColumn("_e", F.col("_start") + F.sum("_n").over(in_cell))
        .withColumn("_s", F.col("_e") - F.col("_n"))
        .where((F.col("_s") <= upper) & (F.col("_e") > lower))
        .groupBy(*keys)
        .agg(
            F.max("_total").alias("count"),
            F.max("_min").alias("min"),
            F.max("_max").alias("max"),
            ((F.min(value) + F.max(value)) / 2).alias("median"),
        )
    )
