"""Shared helpers of this subpackage: documents, tables in the shared folder, Arrow blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a worker turns into arrays at once. A single longer text is one block.
BLOCK_BYTES = 4 << 20
#: Rows of an Arrow batch with texts.
TEXT_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-llm-")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session may go without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return f"file://{_local_root()}"
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over rows with texts, in batches of at most ``TEXT_ROWS`` rows.

    Spark bounds a batch by its rows only, and the default of 10,000 long texts is too much for a worker. The
    setting stays in the session, since the plan runs later.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return rows.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_stats(df: DataFrame, stats: DataFrame, key: str, *, small: int = 10_000, salts: int = 64) -> DataFrame:
    """Left join of one stored ``stats`` row per ``key`` (NULL is a key) to every row of ``df``.

    Up to ``small`` stats rows, counted first, are broadcast. Beyond that the stats are copied
    ``salts`` times and both sides meet on (key, salt), so that a hot key spreads over the salts.
    The names of the stats, ``_stats_key``, ``_left_salt`` and ``_right_salt`` must not be in ``df``.
    """
    taken = [c for c in stats.columns if c != key]
    right = stats.withColumnRenamed(key, "_stats_key")
    same = F.col(key).eqNullSafe(F.col("_stats_key"))
    if stats.count() <= small:
        joined = df.join(F.broadcast(right), same, "left")
    else:
        hashed = F.xxhash64(*[c for c, t in df.dtypes if t in ("bigint", "int", "string")])
        left = df.withColumn("_left_salt", F.pmod(hashed, F.lit(salts)))
        right = right.withColumn("_right_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        joined = left.join(right, same & (F.col("_left_salt") == F.col("_right_salt")), "left")
    return joined.select(*df.columns, *taken)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.LargeStringArray:
    """The texts of a batch with NULL as the empty text."""
    return batch.column(name).cast(pa.large_string()).fill_null("")


def offsets_of(texts: pa.LargeStringArray) -> np.ndarray:
    """Byte offsets of the texts in their data buffer, one more than texts."""
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes as one array and the offsets in it."""
    at = offsets_of(texts)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.LargeStringArray]]:
    """Cut batches so that the texts of a piece have at most ``limit`` bytes, or are a single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = text_column(batch, name)
        at = offsets_of(texts)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), texts.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shifts and odd factors) over an array of uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
