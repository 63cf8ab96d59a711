"""Object keys: builders and the parser, and path checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_prefix(root: Column, batch_id: Column, shard_id: Column) -> Column:
    """``root/batch/shard_7/``."""
    return F.concat(root, F.lit("/"), batch_id, F.lit("/shard_"), shard_id.cast("string"), F.lit("/"))


def job_prefix(root: Column, batch_id: Column, job: Column) -> Column:
    """``root/batch/job/``."""
    return F.concat(root, F.lit("/"), batch_id, F.lit("/"), job, F.lit("/"))


def marker_key(root: Column, batch_id: Column, shard_id: Column, item: Column) -> Column:
    """Per-shard completion marker of one item."""
    return F.concat(shard_prefix(root, batch_id, shard_id), F.lit("markers/"), item, F.lit(".done"))


def global_marker_key(root: Column, batch_id: Column, item: Column) -> Column:
    """Batch-wide completion marker of one item."""
    return F.concat(root, F.lit("/"), batch_id, F.lit("/global_markers/"), item, F.lit(".done"))


def chunk_key(prefix: Column, index: Column, *, stem: str = "data", ext: str = "") -> Column:
    """Chunk object; the index has at least three digits."""
    text = index.cast("string")
    padded = F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)
    return F.concat(prefix, F.lit(f"{stem}_chunk_"), padded, F.lit(ext))


def parse_key(key: Column, root: str) -> Column:
    """Struct ``batch_id, unit, shard_id, area, name`` of a key under ``root``.

    ``area`` is one of ``done, exitcode, marker, output, global_marker, chunk,
    other``; ``shard_id`` is NULL for jobs and unreadable shard directories.
    """
    rel = F.when(F.startswith(key, F.lit(root + "/")), F.substr(key, F.lit(len(root) + 2)))
    batch = F.regexp_extract(rel, r"(?s)\A([^/]+)/", 1)
    unit = F.regexp_extract(rel, r"(?s)\A[^/]+/([^/]+)/", 1)
    rest = F.regexp_extract(rel, r"(?s)\A[^/]+/[^/]+/(.*)\z", 1)
    shard = F.regexp_extract(unit, r"\Ashard_([0-9]+)\z", 1).try_cast("bigint")
    area = (
        F.when(unit == "global_markers", F.when(rest.endswith(".done"), "global_marker").otherwise("other"))
        .when(rest == "DONE", "done")
        .when(rest == "worker.exitcode", "exitcode")
        .when(rest.rlike(r"(?s)\Amarkers/.*\.done\z"), "marker")
        .when(rest.rlike(r"(?s)\Aoutputs/.+\z"), "output")
        .when(rest.rlike(r"(?s)_chunk_[0-9]+[^/]*\z"), "chunk")
        .otherwise("other")
    )
    name = (
        F.when(area == "global_marker", F.regexp_replace(rest, r"\.done\z", ""))
        .when(area == "marker", F.regexp_extract(rest, r"(?s)\Amarkers/(.*)\.done\z", 1))
        .when(area == "output", F.regexp_replace(rest, r"\Aoutputs/", ""))
        .otherwise(rest)
    )
    return F.when(
        rel.isNotNull() & (unit != ""),
        F.struct(
            batch.alias("batch_id"), unit.alias("unit"), shard.alias("shard_id"), area.alias("area"), name.alias("name")
        ),
    )


def chunk_index(name: Column) -> Column:
    """Chunk number of a chunk object name, as a number."""
    return F.regexp_extract(name, r"_chunk_([0-9]+)[^/]*\z", 1).try_cast("bigint")


def basename(path: Column) -> Column:
    """Last path segment."""
    return F.substring_index(path, "/", -1)


def safe_path(path: Column) -> Column:
    """Relative, non-empty and without a parent step."""
    return F.coalesce(
        (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False)
    )
