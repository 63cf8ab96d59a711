"""A keyed table in versions: concurrent writers without lost updates, by optimistic concurrency on shared storage.

A writer reads a version, and proposes rows that replace those of some keys (a key may be left without rows). Proposed data
lies under the attempt's own name, so attempts never touch each other's files and an interrupted one stays invisible. To
commit, an attempt claims its parent version; of all claims on one parent the first counts (storage time of the claim, then
name), and its attempt becomes the next version by a row in ``versions``. A loser whose keys no later version has touched claims the new
head; otherwise it gets a ``Conflict`` and has to read again. A version is the latest rows of each key up to it.

A claim is judged ``settle`` seconds after it was written: longer than the resolution and the visibility delay of
the storage's clock, so that no earlier claim can turn up afterwards. A writer that died between claim and version row is finished by
the next one, whose claim on the same parent comes second. Version rows may be written twice, with the same content.

Everything is a Spark read or write of Parquet, and no two jobs write to one folder, since the first to end would take the
temporary files of the other: ``rows/attempt=...``, ``keys/attempt=...``, ``claims/parent=.../attempt=...`` and
``versions/attempt=.../by=...``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLAIM = "of bigint, attempt string"
_VERSION = "version bigint, parent bigint, attempt string, by string"


class Conflict(RuntimeError):
    """Another writer has committed rows of the same keys since the version that was read."""


class Undecided(RuntimeError):
    """No claim came first in the allowed number of tries."""


def _present(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder, or no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Versions:
    """The table in folder ``root``, of rows with the columns ``schema``, replaced by ``key``."""

    spark: SparkSession
    root: str
    schema: str
    key: str
    settle: float = 1.0

    def _log(self) -> DataFrame:
        return _present(self.spark, f"{self.root}/versions", _VERSION).select("version", "parent", "attempt").distinct()

    def head(self) -> int:
        """The latest version, 0 before the first."""
        return self._log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def touched(self, *, after: int = 0, upto: int | None = None) -> DataFrame:
        """Keys written by the versions after ``after``, with the ``version`` and its ``attempt``."""
        log = self._log().where(F.col("version") > after)
        if upto is not None:
            log = log.where(F.col("version") <= upto)
        return self._keys().join(log.select("attempt", "version"), "attempt")

    def _keys(self) -> DataFrame:
        kind = self.spark.createDataFrame([], self.schema).select(self.key).schema[0].dataType.simpleString()
        return _present(self.spark, f"{self.root}/keys", f"{self.key} {kind}, attempt string")

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version (default: the latest), with the ``version`` that wrote them."""
        upto = self.head() if version is None else version
        latest = self.touched(upto=upto).groupBy(F.col(self.key).alias("_key")).agg(F.max(F.struct("version", "attempt")).alias("_last"))
        latest = latest.select("_key", F.col("_last.version").alias("version"), F.col("_last.attempt").alias("_attempt"))
        rows = _present(self.spark, f"{self.root}/rows", f"{self.schema}, attempt string")
        found = rows.join(latest, rows[self.key].eqNullSafe(F.col("_key")) & (F.col("attempt") == F.col("_attempt")))
        return found.drop("attempt", "_attempt", "_key")

    def propose(self, rows: DataFrame, keys: DataFrame | None = None) -> str:
        """Write the rows that replace those of ``keys`` (default: the keys they have) and return the attempt's name."""
        attempt = uuid.uuid4().hex
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        rows.write.parquet(f"{self.root}/rows/attempt={attempt}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.root}/rows/attempt={attempt}").select(self.key)
        every = written if keys is None else written.unionByName(keys.select(self.key))
        every.distinct().write.parquet(f"{self.root}/keys/attempt={attempt}")
        return attempt

    def _confirm(self, parent: int, attempt: str) -> None:
        row = self.spark.range(1).select(F.lit(parent + 1).cast("bigint").alias("version"), F.lit(parent).cast("bigint").alias("parent"))
        row.coalesce(1).write.parquet(f"{self.root}/versions/attempt={attempt}/by={uuid.uuid4().hex}")

    def claim(self, attempt: str, parent: int) -> None:
        """Ask for the place after ``parent``; ``decide`` tells who has it."""
        row = self.spark.range(1).select(F.lit(parent).cast("bigint").alias("of"))
        row.coalesce(1).write.parquet(f"{self.root}/claims/parent={parent}/attempt={attempt}")

    def decide(self, parent: int) -> str | None:
        """The attempt whose claim on ``parent`` came first; its version row is written if it is missing."""
        claims = _present(self.spark, f"{self.root}/claims/parent={parent}", _CLAIM)
        if not claims.inputFiles():
            return None
        first = claims.select("attempt", F.col("_metadata.file_modification_time").alias("at")).orderBy("at", "attempt").first()
        if self._log().where(F.col("parent") == parent).isEmpty():
            self._confirm(parent, first.attempt)
        return first.attempt

    def commit(self, attempt: str, parent: int, *, tries: int = 20) -> int:
        """Make an attempt based on version ``parent`` the next version and return its number, or raise ``Conflict``."""
        base = parent
        for _ in range(tries):
            own = _present(self.spark, f"{self.root}/claims/parent={base}", _CLAIM).where(F.col("attempt") == attempt)
            if own.isEmpty():
                self.claim(attempt, base)
            time.sleep(self.settle)
            if self.decide(base) == attempt:
                return base + 1
            base += 1
            self._refuse_overlap(attempt, parent, base)
        raise Undecided(f"no place for attempt {attempt} after version {parent} in {tries} tries")

    def _refuse_overlap(self, attempt: str, parent: int, upto: int) -> None:
        mine = self._keys().where(F.col("attempt") == attempt).select(F.col(self.key).alias("_key"))
        theirs = self.touched(after=parent, upto=upto)
        lost = mine.join(theirs, F.col("_key").eqNullSafe(F.col(self.key)), "left_semi")
        if not lost.isEmpty():
            raise Conflict(f"keys of attempt {attempt} were written after version {parent}")

    def update(self, change: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]], *, tries: int = 5) -> int:
        """Read, apply ``change`` (rows, or rows and keys) and commit; after a conflict again on what is there then."""
        for _ in range(tries):
            parent = self.head()
            changed = change(self.read(parent))
            rows, keys = changed if isinstance(changed, tuple) else (changed, None)
            try:
                return self.commit(self.propose(rows.drop("version"), keys), parent)
            except Conflict:
                continue
        raise Undecided(f"a conflict in each of {tries} tries")
