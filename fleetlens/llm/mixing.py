"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean repetition rate: its target share of the corpus divided by its present share
(both in characters). A document's count is the Poisson quantile of a uniform number that an md5 of
its id and the seed gives, so the same document always gets the same count, on every run and task.
The document is exploded by its count, and the copies are dealt to random partitions and sorted by a
hash of (document, copy): a global shuffle.

A rate above ``PART`` is split into equal parts with a uniform number each (a sum of Poisson numbers
is one), so that exp(-rate) never underflows. Documents of a source with over ``BLOCK`` parts are dealt to tasks in blocks of
parts before they are repeated, so that one document of a tiny source is no task's whole work; their copies are numbered by
running sums over the blocks, a row each. A document has at most 2^31 - 1 copies. The source sizes are one partial aggregate; they are
broadcast up to a counted bound and joined with salt beyond it.

Edge cases: a NULL source is a source of its own; a NULL or empty text has no characters; a source
without any characters keeps rate 1 when its weight is positive; sources that ``weights`` does not
name have ``default_weight``; a weight of 0 removes the source; rows with an equal ``doc_id`` get
equal counts; a NULL ``doc_id`` hashes like an empty one; further columns are kept, but ``copy`` and
``shuffle_key`` are replaced and names with ``_mix_`` are taken; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.tables import join_stats, partitions, stored

#: Largest rate that is inverted in one go.
PART = 64.0
#: Parts of a rate that one row stands for.
BLOCK = 1024
#: 52 bits of a hash as a number in [0, 1).
_UNIT = float(1 << 52)


def uniform(*parts: Column) -> Column:
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(_UNIT)


def poisson_quantile(u: Column, rate: Column) -> Column:
    """The least k whose cumulated Poisson probability exceeds ``u``; ``rate`` is at most ``PART``."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int"))
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(
            p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + (u >= acc["cdf"]).cast("int")).alias("k")
        )

    return F.aggregate(steps, first, step, lambda acc: acc["k"])


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float, budget: float | None) -> DataFrame:
    """Mean repetition rate of each source. ``budget`` is the wanted size in characters (default: the present one)."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    weighed = stored(sizes.withColumn("weight", weight), "mixing-sizes")
    total = weighed.agg(F.sum("size").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weight")).first()
    if total.size is None or not total.weight:
        return weighed.select("source", (F.col("weight") > 0).cast("double").alias("rate"))
    wanted = float(total.size if budget is None else budget)
    rate = F.col("weight") * wanted / F.lit(float(total.weight)) / F.col("size")
    return weighed.select("source", F.when(F.col("size") > 0, rate).otherwise((F.col("weight") > 0).cast("double")).alias("rate"))


def mix(
    docs: DataFrame, weights: dict[str, float], *, default_weight: float = 1.0, budget: float | None = None, seed: int = 0, small_sources: int = 10_000
) -> DataFrame:
    """Documents repeated to the target mixture in random order, with ``copy`` (from 0) and ``shuffle_key``."""
    docs = docs.drop("copy", "shuffle_key")
    by_source = rates(docs, weights, default_weight, budget).withColumnRenamed("rate", "_mix_rate")
    rated = join_stats(docs, by_source, "source", small=small_sources)
    rate = F.col("_mix_rate")
    pieces = F.greatest(F.ceil(rate / PART).cast("int"), F.lit(1))
    part = rate / pieces

    def count(first: Column, last: Column) -> Column:
        counts = F.transform(F.sequence(first, last), lambda i: poisson_quantile(uniform(F.lit(seed), F.col("doc_id"), i), part))
        return F.when(rate > 0, F.aggregate(counts, F.lit(0), lambda a, c: a + c)).otherwise(F.lit(0))

    def repeated(counted: DataFrame, first: Column) -> DataFrame:
        copy = F.explode(F.sequence(F.lit(0), F.col("_mix_count") - 1))
        return counted.where(F.col("_mix_count") > 0).withColumn("copy", copy).withColumn("copy", (first + F.col("copy")).cast("int"))

    highest = by_source.agg(F.max("_mix_rate")).first()[0]
    if highest is None or highest <= BLOCK * PART:
        copies = repeated(rated.withColumn("_mix_count", count(F.lit(1), pieces)), F.lit(0))
    else:
        usual = rated.where(F.coalesce(rate <= BLOCK * PART, F.lit(True)))
        block = F.explode(F.sequence(F.lit(1), pieces, F.lit(BLOCK)))
        last = F.least(F.col("_mix_block") + BLOCK - 1, pieces)
        # ids, not texts: equal ids of a source have equal counts
        blocks = rated.where(rate > BLOCK * PART).select("doc_id", "source", "_mix_rate").distinct().withColumn("_mix_block", block)
        blocks = blocks.repartition(partitions(docs.sparkSession), "doc_id", "_mix_block").withColumn("_mix_count", count(F.col("_mix_block"), last))
        before = Window.partitionBy("doc_id", "source").orderBy("_mix_block").rowsBetween(Window.unboundedPreceding, -1)
        first = F.coalesce(F.sum("_mix_count").over(before), F.lit(0)).alias("_mix_first")
        placed = stored(blocks.select(F.struct("doc_id", "source").alias("_mix_key"), "_mix_block", "_mix_count", first), "mixing-blocks")
        dealt = rated.where(rate > BLOCK * PART).withColumns({"_mix_key": F.struct("doc_id", "source"), "_mix_block": block})
        dealt = dealt.repartition(partitions(docs.sparkSession), "_mix_key", "_mix_block").join(placed, ["_mix_key", "_mix_block"])
        many = repeated(dealt, F.col("_mix_first"))
        copies = repeated(usual.withColumn("_mix_count", count(F.lit(1), pieces)), F.lit(0)).unionByName(many.select(*docs.columns, "_mix_rate", "_mix_count", "copy"))
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy")))
    dealt = keyed.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select(*docs.columns, "copy", "shuffle_key")
