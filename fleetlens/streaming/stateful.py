"""Streams whose state needs code: retries, stuck units, rechecks, chunks and running spend.

Rows of a key wait in its state until the watermark has passed their time bucket and are then folded in event order, so
rows may come in any order within ``delay`` and the result is the batch operator's. The state is typed
(``transformWithState``, which needs the RocksDB state store; it is set in the session): a map from (cell, part) to the
rows that one batch brought for that cell, a map of the parts of each cell, and one value with what was folded. A cell holds the waiting
rows of one or more buckets and is named by the first of them, whose event-time timer opens it: few rows of a batch share one cell, many go to cells that
double in width with their distance from the watermark. All open cells of a key are read in one go, the rows that are due folded in one go, and the
rest waits in new cells, so the calls on the state of a key grow with its batches and not with its rows or buckets, and a waiting row is written
again at most once for each doubling (or, among few, at each opening). A wider ``bucket`` means
fewer timers and a result that comes up to a bucket later. A state without waiting rows is dropped after ``forget`` of silence; a key that comes back
later starts anew. ``initial`` gives keys a folded state to start from, for example from a batch over older rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from fleetlens import constants as C
from fleetlens.operators.polling import with_snapshot
from fleetlens.operators.units import budget_status

VERDICT_SCHEMA = "event_id long, unit_key string, retries_before long, verdict string, failure_reason string"
STUCK_SCHEMA = "event_id long, unit_key string, micros long, reason string"
RECHECK_SCHEMA = "event_id long, unit_key string, micros long, action string, detail string"
CHUNK_SCHEMA = "file_id string, event_id long, chunk_index long, offset long, length long"
SPEND_SCHEMA = "batch_id string, start_ms long, micros long, total_micros long"
_YEAR, _HOUR = "365 days", "1 hour"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a key that wait in one cell, however many buckets they are of.
_FEW = 1000

#: ``fold(key, rows in event order, state)`` gives output rows and the new state, which may hold the time ``due`` (ms) it can be dropped.
Fold = Callable[[str, pd.DataFrame, dict[str, Any]], tuple[pd.DataFrame, dict[str, Any]]]


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


#: Arrays that need no objects where nothing is NULL.
_KINDS = {"bigint": np.int64, "boolean": bool}


def _objects(values: pd.Series) -> np.ndarray:
    """Values as they are stored: NULL is None."""
    if values.dtype == object or values.hasnans:
        return values.astype(object).where(values.notna(), None).to_numpy()
    return values.to_numpy()


class _Folder(StatefulProcessor):
    """Waiting rows by time bucket, folded when the bucket's timer fires."""

    def __init__(self, columns: dict[str, str], out: list[str], state: str, fold: Fold, bucket_ms: int, keep_ms: int):
        self.columns, self.out, self.state, self.fold = columns | {"_end": "bigint"}, out, state, fold
        self.fields = [c.split()[0] for c in state.split(", ")]
        self.bucket_ms, self.keep_ms = bucket_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"`{name}` array<{kind}>" for name, kind in self.columns.items())
        self.waiting = handle.getMapState("waiting", "cell long, part long", arrays)
        self.parts = handle.getMapState("parts", "cell long", "n long")
        self.folded = handle.getValueState("folded", f"{self.state}, due long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N803
        row = initialState.iloc[0]
        # when it was made is not known, so it waits for the first row of its key
        self.folded.update((*[v.tolist() if isinstance(v := row[f], (np.generic, np.ndarray)) else v for f in self.fields], 1 << 62))

    def _passed(self, timerValues: Any) -> int:  # noqa: N803
        """The last bucket that has ended; a bucket is named by its end."""
        return max(0, timerValues.getCurrentWatermarkInMs()) // self.bucket_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        # a bucket that has ended already takes no more rows
        first = self._passed(timerValues) + 1
        for batch in rows:
            ends = np.maximum(-(-batch["at"].to_numpy(np.int64) // (1000 * self.bucket_ms)), first)
            self._wait({c: ends if c == "_end" else _objects(batch[c]) for c in self.columns}, first)
        return iter(())

    def _wait(self, rows: dict[str, np.ndarray], first: int) -> None:
        """Add rows to the cells of their buckets, of which ``first`` is the next to end."""
        ends = rows["_end"]
        cells = np.full(len(ends), ends.min())
        if len(ends) > _FEW:
            width = np.int64(1) << (np.frexp(ends - first + 1)[1] - 1).astype(np.int64)
            cells = ends - ends % width
        for cell in np.unique(cells).tolist():
            own = cells == cell
            known = self.parts.getValue((cell,))
            n = known[0] if known else 0
            self.waiting.updateValue((cell, n), tuple(rows[c][own].tolist() for c in self.columns))
            self.parts.updateValue((cell,), (n + 1,))
            if n == 0:
                self.handle.registerTimer(cell * self.bucket_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        now, passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self._passed(timerValues)
        cells = {cell: n for (cell,), (n,) in self.parts.iterator()}
        if opened := sorted(c for c in cells if c <= passed):
            rows = self._taken([(cell, part) for cell in opened for part in range(cells[cell])])
            due = int(np.searchsorted(rows["_end"], passed, "right"))
            later = {c: v[due:] for c, v in rows.items()}
            if more := len(rows["_end"]) > due:
                self._wait(later, passed + 1)
            known = self.folded.get()
            out, after, ends = self._folds(key[0], {c: v[:due] for c, v in rows.items()}, known)
            if ends > now or more or len(opened) < len(cells):
                self.folded.update((*[after[f] for f in self.fields], ends))
                self.handle.registerTimer(max(ends, now + 1))
            elif known is not None:
                self.folded.clear()
            if len(out):
                yield out[self.out]
        elif not cells and (known := self.folded.get()) is not None and known[-1] <= now:
            self.folded.clear()

    def _folds(self, key: str, rows: dict[str, np.ndarray], known: tuple | None) -> tuple[pd.DataFrame, dict[str, Any], int]:
        """Fold rows that are due; at a bucket's begin, silence ends a state also where its timer has not fired yet."""
        ms, end = rows["at"] // 1000, rows["_end"]
        silent = np.flatnonzero((end[1:] != end[:-1]) & (ms[1:] > ms[:-1] + self.keep_ms)) + 1
        outs, after, due = [], {}, 0
        for begin, stop in zip([0, *silent.tolist()], [*silent.tolist(), len(ms)]):
            alive = known is not None and known[-1] >= ms[begin]
            before = dict(zip(self.fields, known)) if alive else {}
            out, after = self.fold(key, pd.DataFrame({c: v[begin:stop] for c, v in rows.items()}), before)
            due = after.pop("due", int(ms[stop - 1]) + self.keep_ms)
            known = (*[after[f] for f in self.fields], due)
            outs.append(out)
        return pd.concat(outs) if len(outs) > 1 else outs[0], after, due

    def _taken(self, places: list[tuple[int, int]]) -> dict[str, np.ndarray]:
        """The rows of cells by bucket, in event order, which leave the state."""
        parts = []
        for place in places:
            parts.append(self.waiting.getValue(place))
            self.waiting.removeKey(place)
        for cell in {cell for cell, _ in places}:
            self.parts.removeKey((cell,))
        rows = {}
        for i, (name, kind) in enumerate(self.columns.items()):
            values = [v for part in parts for v in part[i]]
            # event ids may be NULL and come last then
            rows[name] = np.array(values, _KINDS.get(kind, object) if None not in values else object)
        ids = rows["event_id"]
        missing = np.array([v is None for v in ids]) if ids.dtype == object else np.zeros(len(ids), bool)
        order = np.lexsort((np.where(missing, 0, ids).astype(np.int64), missing, rows["at"], rows["_end"]))
        return {c: v[order] for c, v in rows.items()}

    def close(self) -> None:
        pass


def _folded(
    source: DataFrame, key: str, schema: str, delay: str, forget: str, state: str, fold: Fold, bucket: str, initial: DataFrame | None = None
) -> DataFrame:
    """Apply ``fold`` to the rows the watermark has passed; ``state`` is the schema of what it keeps.

    ``source`` has the key, ``ts``, ``event_id`` and the columns to fold; ``fold`` gets ``at`` (microseconds)
    in place of ``ts``. A source may bring ``at`` itself for rows that
    are due later than their event time; the watermark follows ``ts`` alone. ``initial`` has the key and the columns of ``state``.
    """
    source.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    timed = source if "at" in source.columns else source.withColumn("at", F.unix_micros("ts"))
    timed = timed.withWatermark("ts", delay)
    columns = {f.name: f.dataType.simpleString() for f in timed.schema.fields if f.name not in (key, "ts")}
    folder = _Folder(columns, [c.split()[0] for c in schema.split(", ")], state, fold, _ms(bucket), _ms(forget))
    start = initial if initial is None else initial.groupBy(key)
    return timed.groupBy(key).transformWithStateInPandas(folder, StructType.fromDDL(schema), "append", "EventTime", start)


def retry_verdict_stream(
    events: DataFrame, *, max_retries: int = C.UNIT_RETRIES, fatal_pattern: str | None = None, delay: str = "10 minutes", forget: str = _YEAR,
    bucket: str = _HOUR, initial: DataFrame | None = None,
) -> DataFrame:
    """Verdict on each instance loss once the watermark has passed it (append mode).

    Reasons that match ``fatal_pattern`` are fatal. ``initial`` (``unit_key, retries``) has the losses before the stream.
    """

    def fold(key: str, rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        before = state.get("retries", 0) + np.arange(len(rows))
        exhausted, fatal = before >= max_retries, rows["fatal"].to_numpy(bool)
        why = np.where(exhausted, rows["reason"] + " (retries exhausted)", np.where(fatal, rows["reason"] + " (fatal)", ""))
        verdict = np.where(exhausted | fatal, "failed", "preempted")
        out = pd.DataFrame({"event_id": rows["event_id"], "unit_key": key, "retries_before": before, "verdict": verdict, "failure_reason": why})
        return out[rows["event"] == "preempted"], {"retries": state.get("retries", 0) + len(rows)}

    fatal = F.col("reason").rlike(fatal_pattern) if fatal_pattern else F.lit(False)
    losses = events.where(F.col("event").isin("failed", "preempted")).select(
        F.col("unit_key").cast("string").alias("unit_key"), "event_id", "ts", "event", "reason", F.coalesce(fatal, F.lit(False)).alias("fatal")
    )
    return _folded(losses, "unit_key", VERDICT_SCHEMA, delay, forget, "retries long", fold, bucket, initial)


def _with_time(folded: DataFrame) -> DataFrame:
    """``micros`` as ``ts``, whatever the session's time zone is."""
    return folded.select(*[F.timestamp_micros("micros").alias("ts") if c == "micros" else c for c in folded.columns])


def _due(timeout_seconds: int) -> Column:
    """Microseconds of the event time and a timeout."""
    return F.unix_micros("ts") + F.lit(timeout_seconds * 1_000_000)


def stuck_unit_stream(
    events: DataFrame, *, timeout_seconds: int = C.BOOT_TIMEOUT_SECONDS, delay: str = "10 minutes", event: str = "deployed", bucket: str = _HOUR
) -> DataFrame:
    """Deployments that nothing followed within the timeout (append mode).

    Every deployment brings a second row that is due a timeout later. When the watermark has passed it, all
    events within the timeout have been folded, and the deployment is stuck if none of them came.
    """
    limit = timeout_seconds * 1_000_000

    def fold(key: str, rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        """The state keeps the times of the last timeout's real events."""
        is_check = rows["check"].to_numpy(bool)
        seen = np.concatenate([np.array(state.get("seen", []), np.int64), rows["at"].to_numpy(np.int64)[~is_check]])
        started = rows["at"].to_numpy(np.int64)[is_check] - limit
        until = np.append(seen, np.iinfo(np.int64).max)[np.searchsorted(seen, started, "right")]
        stuck = until > started + limit
        out = pd.DataFrame(
            {
                "event_id": rows["event_id"].to_numpy()[is_check][stuck],
                "unit_key": key,
                "micros": started[stuck],
                "reason": f"timed out after {timeout_seconds} seconds",
            }
        )
        last = int(rows["at"].iloc[-1])
        return out, {"seen": np.unique(seen[seen >= last - limit]).tolist(), "due": (last + limit) // 1000 + 1}

    source = events.select(F.col("unit_key").cast("string").alias("unit_key"), "event_id", "ts", "event")
    own = F.struct(F.unix_micros("ts").alias("at"), F.lit(False).alias("check"))
    check = F.struct(_due(timeout_seconds).alias("at"), F.lit(True).alias("check"))
    both = F.when(F.col("event") == event, F.array(own, check)).otherwise(F.array(own))
    rows = source.select("unit_key", "event_id", "ts", F.explode(both).alias("e")).select("unit_key", "event_id", "ts", "e.at", "e.check")
    return _with_time(_folded(rows, "unit_key", STUCK_SCHEMA, delay, _YEAR, "seen array<long>", fold, bucket))


def dead_recheck_stream(probes: DataFrame, markers: DataFrame, *, wait_seconds: int, delay: str = "10 minutes", bucket: str = _HOUR) -> DataFrame:
    """Dead probes with ``complete`` when a marker comes within the wait, else ``preempt`` (append mode).

    Probes and markers are one stream of rows, a probe due a wait after it was made, so no probe is paired with
    every marker. ``delay`` covers how far one source may lag behind the other.
    """
    limit = wait_seconds * 1_000_000

    def fold(key: str, rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        """The state keeps the times of the last wait's markers."""
        is_probe, at = rows["check"].to_numpy(bool), rows["at"].to_numpy(np.int64)
        seen = np.concatenate([np.array(state.get("seen", []), np.int64), at[~is_probe]])
        started = at[is_probe] - limit
        found = np.append(seen, np.iinfo(np.int64).max)[np.searchsorted(seen, started, "left")] <= started + limit
        out = pd.DataFrame(
            {
                "event_id": rows["event_id"].to_numpy()[is_probe],
                "unit_key": key,
                "micros": started,
                "action": np.where(found, "complete", "preempt"),
                "detail": np.where(found, None, rows["log_tail"].to_numpy(object)[is_probe]),
            }
        )
        last = int(at[-1])
        return out, {"seen": np.unique(seen[seen >= last - limit]).tolist(), "due": (last + limit) // 1000 + 1}

    dead = with_snapshot(probes).where(F.col("_probe.worker_dead") & ~F.col("_probe.complete"))
    key = F.col("unit_key").cast("string").alias("unit_key")
    checks = dead.select(key, "event_id", "ts", _due(wait_seconds).alias("at"), F.lit(True).alias("check"), F.col("_probe.log_tail").alias("log_tail"))
    marks = markers.select(
        key,
        F.lit(-1).cast("bigint").alias("event_id"),
        F.col("marker_ts").alias("ts"),
        F.unix_micros("marker_ts").alias("at"),
        F.lit(False).alias("check"),
        F.lit(None).cast("string").alias("log_tail"),
    )
    return _with_time(_folded(checks.unionByName(marks), "unit_key", RECHECK_SCHEMA, delay, _YEAR, "seen array<long>", fold, bucket))


def chunk_stream(sizes: DataFrame, *, delay: str = "10 minutes", forget: str = _YEAR, bucket: str = _HOUR) -> DataFrame:
    """Chunks of growing files once the watermark has passed the observed size (append mode)."""

    def fold(key: str, rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        size = rows["bytes"].to_numpy(np.int64)
        start = state.get("offset", 0)
        seen = np.maximum.accumulate(np.concatenate([[start], size]))
        grown = size > seen[:-1]
        index = state.get("chunks", 0) + np.arange(int(grown.sum()))
        out = pd.DataFrame({"file_id": key, "event_id": rows["event_id"].to_numpy()[grown], "chunk_index": index, "offset": seen[:-1][grown], "length": size[grown] - seen[:-1][grown]})
        return out, {"offset": int(seen[-1]), "chunks": int(state.get("chunks", 0) + grown.sum())}

    source = sizes.select("file_id", "event_id", "ts", F.col("size").alias("bytes"))
    return _folded(source, "file_id", CHUNK_SCHEMA, delay, forget, "offset long, chunks long", fold, bucket)


class _Spending(StatefulProcessor):
    """A sum per open window and the total of the closed ones."""

    def __init__(self, width_ms: int, keep_ms: int):
        self.width_ms, self.keep_ms = width_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "ends long", "micros long")
        self.total = handle.getValueState("total", "micros long, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        for batch in rows:
            for end, micros in batch.groupby("end_ms")["micros"].sum().items():
                known = self.windows.containsKey((int(end),))
                before = self.windows.getValue((int(end),))[0] if known else 0
                self.windows.updateValue((int(end),), (before + int(micros),))
                if not known:
                    self.handle.registerTimer(int(end))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        if self.windows.containsKey((end,)):
            micros = self.windows.getValue((end,))[0]
            known = self.total.get() if self.total.exists() else (0, 0)
            total = micros + (known[0] if known[1] >= end - self.width_ms else 0)
            self.windows.removeKey((end,))
            self.total.update((total, end + self.keep_ms))
            self.handle.registerTimer(end + self.keep_ms)
            yield pd.DataFrame({"batch_id": [key[0]], "start_ms": [end - self.width_ms], "micros": [micros], "total_micros": [total]})
        elif self.total.exists() and self.total.get()[1] <= end and next(self.windows.keys(), None) is None:
            self.total.clear()

    def close(self) -> None:
        pass


def spend_status_stream(spend: DataFrame, ceiling: float, *, width: str = "1 day", delay: str = "1 hour", forget: str = _YEAR) -> DataFrame:
    """Per batch and closed window: spend, running total and budget status (append mode).

    The state of a batch is its total and one sum per open window, however many rows they get; it is dropped
    after ``forget`` without spend.
    """
    spend.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    width_ms = _ms(width)
    micros = (F.col("amount").cast("decimal(18,6)") * 1_000_000).cast("bigint").alias("micros")
    end = F.unix_millis("ts") - F.pmod(F.unix_millis("ts"), F.lit(width_ms)) + width_ms
    rows = spend.withWatermark("ts", delay).select("batch_id", "ts", end.alias("end_ms"), micros)
    summed = rows.groupBy("batch_id").transformWithStateInPandas(_Spending(width_ms, _ms(forget)), StructType.fromDDL(SPEND_SCHEMA), "append", "EventTime")
    whole = F.col("total_micros") / 1e6
    return summed.select(
        "batch_id",
        F.floor(F.col("start_ms") / 1000).alias("window_start"),
        (F.col("micros") / 1e6).alias("spent"),
        whole.alias("total"),
        budget_status(whole, F.lit(ceiling)).alias("status"),
    )
