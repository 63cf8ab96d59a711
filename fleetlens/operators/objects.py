"""Object inventories: progress markers, manifests, chunks and payload names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.keys import basename, chunk_index, parse_key, safe_path
from fleetlens.operators.ordered import DAY, Running, positions, running
from fleetlens.session import stored

CHUNKS_PER_SLICE = 4096


def list_objects(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects under ``prefix`` with ``rel_path``; the key that equals the prefix is left out."""
    return objects.where(F.col("key").startswith(prefix) & (F.col("key") != prefix)).withColumn(
        "rel_path", F.substr("key", F.lit(len(prefix) + 1))
    )


def parsed(objects: DataFrame, root: str) -> DataFrame:
    """Add ``batch_id, unit, shard_id, area, name``; keys outside ``root`` are dropped."""
    return (
        objects.withColumn("_p", parse_key(F.col("key"), root))
        .where(F.col("_p").isNotNull())
        .select("*", "_p.*")
        .drop("_p")
    )


def shard_progress(objects: DataFrame, root: str) -> DataFrame:
    """Completed items per shard, from its markers."""
    marks = parsed(objects, root).where((F.col("area") == "marker") & F.col("shard_id").isNotNull())
    return marks.groupBy("bucket", "batch_id", "shard_id").agg(F.count("*").alias("completed"))


def batch_progress(objects: DataFrame, root: str) -> DataFrame:
    """Completed items per batch, from the batch-wide markers."""
    marks = parsed(objects, root).where(F.col("area") == "global_marker")
    return marks.groupBy("bucket", "batch_id").agg(F.count("*").alias("completed"))


def done_shards(objects: DataFrame, root: str) -> DataFrame:
    """Shards with a DONE object and their place in the sorted list of the batch; unreadable directories are ignored."""
    done = parsed(objects, root).where((F.col("area") == "done") & F.col("shard_id").isNotNull())
    return positions(done.select("bucket", "batch_id", "shard_id").distinct(), ["bucket", "batch_id"], "shard_id")


def batch_manifest(objects: DataFrame, root: str) -> DataFrame:
    """Objects and bytes per batch: what deleting the batch would remove."""
    return (
        parsed(objects, root)
        .groupBy("bucket", "batch_id")
        .agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
    )


def latest_markers(markers: DataFrame, keys: Sequence[str] = ("unit_key",)) -> DataFrame:
    """One marker per key, the latest written; marking twice changes nothing else."""
    last = F.max(F.struct("marker_ts", "event_id", "worker_id")).alias("_last")
    return (
        markers.groupBy(*keys)
        .agg(last, F.count("*").alias("writes"))
        .select(*keys, "_last.marker_ts", "_last.worker_id", "writes")
    )


def covering_rules(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (object, enabled rule) whose prefix covers the key.

    Each bucket uses few distinct prefix lengths. A key is cut to exactly those
    lengths and joined on equality, so no pair is tried that does not match.
    """
    enabled = rules.where((F.col("status") == "Enabled") & F.col("days").isNotNull()).select(
        "bucket", F.coalesce("prefix", F.lit("")).alias("_head"), F.col("id").alias("rule_id"), "pos", "days"
    )
    lengths = enabled.groupBy("bucket").agg(F.collect_set(F.length("_head")).alias("_lengths"))
    heads = (
        objects.join(lengths, "bucket")
        .withColumn("_len", F.explode(F.filter("_lengths", lambda n: n <= F.length("key"))))
        .withColumn("_head", F.substr("key", F.lit(1), F.col("_len")))
    )
    return heads.join(enabled, ["bucket", "_head"]).drop("_lengths", "_len").withColumnRenamed("_head", "rule_prefix")


def expiring_objects(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Objects old enough for a rule that covers them, one row per rule."""
    return covering_rules(objects, rules).where(F.col("age_days") >= F.col("days"))


def expiring_summary(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Objects and bytes per rule, each object counted for the rule that takes it first."""
    first = (
        expiring_objects(objects, rules)
        .groupBy("bucket", "key")
        .agg(F.min_by("rule_id", F.struct("days", "pos")).alias("rule_id"), F.max("size").alias("size"))
    )
    return first.groupBy("bucket", "rule_id").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def chunk_order(objects: DataFrame, root: str) -> DataFrame:
    """Chunk objects with their file, numeric index and place in the file's order; equal indices go by key."""
    chunks = parsed(objects, root).where(F.col("area") == "chunk")
    numbered = chunks.withColumn("file", F.regexp_replace("key", r"_chunk_[0-9]+[^/]*\z", "")).withColumn(
        "chunk_index", chunk_index(F.col("name"))
    )
    return positions(numbered, ["bucket", "file"], "chunk_index", ties=["key"])


def chunk_plan(sizes: DataFrame, *, slice_seconds: int = DAY) -> DataFrame:
    """Chunks of growing files: only growth past everything seen before emits one."""
    seen = running(
        sizes,
        ["file_id"],
        "ts",
        ["event_id"],
        [Running("_before", "max", F.col("size"), include_current=False)],
        slice_seconds=slice_seconds,
    ).withColumn("_before", F.coalesce("_before", F.lit(0)))
    # few rows of the sizes, numbered in a second pass
    grown = stored(seen.where(F.col("size") > F.col("_before")).select("file_id", "event_id", "ts", "size", "_before"), "grown")
    numbered = running(
        grown,
        ["file_id"],
        "ts",
        ["event_id"],
        [Running("chunk_index", "sum", F.lit(1), include_current=False)],
        slice_seconds=slice_seconds,
    )
    return numbered.select(
        "file_id",
        "event_id",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("_before").cast("bigint").alias("offset"),
        (F.col("size") - F.col("_before")).alias("length"),
    )


def consolidate(chunks: DataFrame, *, content: str | None = "content") -> DataFrame:
    """Give each chunk of a file its byte offset in the joined file.

    Chunks are taken in numeric order. The joined file is the chunks' bytes by
    offset; it stays one row per chunk, because a whole file need not fit into
    one value. ``length`` is computed from ``content`` when that is given.
    """
    sized = chunks if content is None else chunks.withColumn("length", F.octet_length(content))
    return running(
        sized,
        ["file_id"],
        "chunk_index",
        [],
        [Running("offset", "sum", F.col("length"), include_current=False)],
        slice_by=F.floor(F.col("chunk_index") / CHUNKS_PER_SLICE),
    ).withColumn("offset", F.col("offset").cast("bigint"))


def consolidated_files(chunks: DataFrame, *, content: str | None = "content") -> DataFrame:
    """Chunks and bytes per joined file."""
    size = F.col("length") if content is None else F.octet_length(content)
    return chunks.groupBy("file_id").agg(
        F.count("*").alias("chunks"), F.sum(size.cast("bigint")).alias("bytes"), F.max("chunk_index").alias("last_chunk")
    )


def ordered_segments(consolidated: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in file and offset order across partitions, ready to be written as they are."""
    keys = ["file_id", "offset"]
    ranged = consolidated.repartitionByRange(partitions, *keys) if partitions else consolidated.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def path_safety(paths: DataFrame, column: str = "path") -> DataFrame:
    """Add ``safe``: relative, non-empty, without a parent step."""
    return paths.withColumn("safe", safe_path(F.col(column)))


def duplicate_names(payloads: DataFrame, keys: Sequence[str] = ("payload_id",), column: str = "path") -> DataFrame:
    """File names that occur more than once in a payload."""
    named = payloads.withColumn("name", basename(F.col(column))).where(F.col("name") != "")
    return named.groupBy(*keys, "name").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
