"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes (``insert``, ``delete``, ``revise``) is folded into signed totals per key: an insert
adds its count, a delete takes it back, a revision takes the old count from the old key and adds the
new one to the new key. Folding is a partial aggregate, so a hot source costs one row per task.

The ledger is a folder of immutable delta tables. A batch writes its deltas under an attempt of its
own and becomes visible by one commit row; totals read the committed attempts only, and of several
commits of one batch the first in order of the attempt's name, so a batch that is sent twice, or a
job that dies half-way and runs again, counts once. ``compact`` folds the committed batches into one
base table under the same rule.

Edge cases: NULL source, language or version are keys of their own; a NULL count is 0; a NULL ``doc_id``
counts like any other; an unknown operation fails the batch before it commits; keys whose documents and tokens return to 0 leave
the totals; an empty batch commits and changes nothing; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
CHANGES = "op string, source string, lang string, version string, n_tokens bigint, old_source string, old_lang string, old_version string, old_tokens bigint"
_DELTAS = "source string, lang string, version string, d_docs bigint, d_tokens bigint"
_COMMITS = "batch string, attempt string"


def changes(docs: DataFrame, op: str, version: Column, n_tokens: Column, old_version: Column | None = None, old_tokens: Column | None = None) -> DataFrame:
    """Change rows of one operation from documents with ``source`` and ``lang``."""
    old = [F.col("source"), F.col("lang"), old_version, old_tokens] if op == "revise" else [F.lit(None)] * 4
    values = [F.lit(op), F.col("source"), F.col("lang"), version, n_tokens, *old]
    names = [c.split()[0] for c in CHANGES.split(", ")]
    kinds = [c.split()[1] for c in CHANGES.split(", ")]
    return docs.select(*[v.cast(k).alias(n) for v, n, k in zip(values, names, kinds)])


def deltas(batch: DataFrame) -> DataFrame:
    """Signed totals per key."""
    op = F.col("op")

    def entry(sign: int, prefix: str = "") -> Column:
        tokens = F.coalesce(F.col("old_tokens" if prefix else "n_tokens"), F.lit(0).cast("bigint"))
        return F.struct(*[F.col(prefix + k).alias(k) for k in KEYS], F.lit(sign).cast("bigint").alias("d_docs"), (sign * tokens).alias("d_tokens"))

    signed = (
        F.when(op == "insert", F.array(entry(1)))
        .when(op == "delete", F.array(entry(-1)))
        .when(op == "revise", F.array(entry(-1, "old_"), entry(1)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("NULL")))))
    )
    return batch.select(F.inline(signed)).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))


class Ledger:
    """Committed delta batches in one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _commits(self) -> DataFrame:
        """The first attempt of each committed batch; the folder may not exist yet."""
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.folder}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _COMMITS)
        return rows.groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def apply(self, batch: str, rows: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        if self._commits().where(F.col("batch") == batch).limit(1).count():
            return False
        attempt = uuid.uuid4().hex
        deltas(rows).write.parquet(f"{self.folder}/deltas/attempt={attempt}")
        self.spark.createDataFrame([(batch, attempt)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens per key over all committed batches."""
        committed = self._commits().select("attempt")
        if not committed.limit(1).count():
            return self.spark.createDataFrame([], "source string, lang string, version string, n_docs bigint, n_tokens bigint")
        rows = self.spark.read.schema(_DELTAS + ", attempt string").parquet(f"{self.folder}/deltas")
        kept = rows.join(committed, "attempt", "left_semi")
        summed = kept.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return summed.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self, folder: str) -> Ledger:
        """A new ledger in ``folder`` with today's totals as its base and every batch name still known."""
        new = Ledger(self.spark, folder)
        base = self.totals().withColumnsRenamed({"n_docs": "d_docs", "n_tokens": "d_tokens"})
        base.write.parquet(f"{folder}/deltas/attempt=base")
        names = self._commits().select("batch", F.lit("base").alias("attempt"))
        names.write.parquet(f"{folder}/commits")
        return new
