"""Best-fit packing of token sequences: local best fit, then a tree of merges over the underfull bins.

Level 0 runs where the documents are read. Each task cuts its documents into pieces of at most
``capacity`` tokens, packs them by best fit (longest piece first, into the fullest bin that still has
room) and marks bins with at most ``slack`` free tokens as finished. Only the underfull bins go on:
they are the items of the next level, where the bins of ``fan_in`` neighbouring groups meet in one
task and are packed again. The fan-in follows from the counted underfull bins, so that a task never
gets more than about ``group_bins`` of them; the tree ends at one group, or when a level joins less
than one bin in a hundred. Best fit leaves at most one bin per group that is at most half full; where
several groups are left, these bins are packed together once more, so that at most one of them stays.

What moves between tasks is the layout (48 bytes a piece), never the tokens. Every level is a table
in the shared folder, so a lost executor repeats one level at most.

Edge cases: a NULL or empty text is one piece with the end id only; a longer document is cut from its
end, so the first piece is the short one; rows with an equal ``doc_id`` are packed each; further
columns are ignored; an empty table gives an empty layout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import blocks, map_texts, stored
from fleetlens.llm.tokens import encoder

#: A task of level 0 packs at most about this many pieces together.
LOCAL_PIECES = 200_000

_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
_BINS = pa.schema(
    [("grp", pa.int64()), ("sequence_id", pa.int64()), ("used", pa.int64()), ("done", pa.bool_()), ("pieces", pa.list_(pa.struct(_PIECE)))]
)
BINS = (
    "grp bigint, sequence_id bigint, used bigint, done boolean, "
    "pieces array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, longest first into the fullest bin with room; equal sizes in input order.

    The free bins are kept by room, the rooms that occur as bits of one integer, so that the
    smallest sufficient room is found without a search over bins.
    """
    order = np.argsort(-sizes, kind="stable")
    placed = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            free = by_room[room]
            chosen = free.pop()
            if not free:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, made
            made += 1
        placed[item] = chosen
        left = room - size
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return placed


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: the document's number, the piece's number, start and length; the first piece takes the rest."""
    count = np.maximum(1, -(-lengths // capacity))
    doc = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    head = lengths[doc] - capacity * (count[doc] - 1)
    start = np.where(number == 0, 0, head + capacity * (number - 1))
    return doc, number, start, np.where(number == 0, head, capacity)


def _bins(pieces: pa.StructArray, bins: np.ndarray, group: int, first_id: int, capacity: int, slack: int) -> pa.RecordBatch:
    """Rows of bins from pieces and their bin numbers."""
    order = np.argsort(bins, kind="stable")
    sorted_bins = bins[order]
    taken = pieces.take(pa.array(order))
    length = taken.field(3).to_numpy()
    at = np.append(np.flatnonzero(np.diff(sorted_bins, prepend=-1)), len(order))
    before = np.cumsum(length) - length
    offset = before - np.repeat(before[at[:-1]], np.diff(at))
    used = np.add.reduceat(length, at[:-1]) if len(order) else np.zeros(0, np.int64)
    fields = [taken.field(i) for i in range(5)] + [pa.array(offset, pa.int64())]
    rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, names=[n for n, _ in _PIECE]))
    n = len(used)
    ids = first_id + np.arange(n)
    arrays = [pa.array(np.full(n, group)), pa.array(ids), pa.array(used), pa.array(used >= capacity - slack), rows.cast(_BINS.field("pieces").type)]
    return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, _BINS.types)], schema=_BINS)


def _parts(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _local(path: str, capacity: int, end_id: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(path), TaskContext.get().partitionId()
        waiting: list[pa.StructArray] = []
        held, made = 0, 0

        def pack() -> pa.RecordBatch:
            nonlocal waiting, held, made
            pieces = pa.concat_arrays(waiting)
            bins = best_fit(pieces.field(3).to_numpy(), capacity)
            out = _bins(pieces, bins, task, (task << 24) + made, capacity, slack)
            waiting, held, made = [], 0, made + out.num_rows
            return out

        for batch, texts in blocks(batches):
            ids, at = coder.encode(texts, end_id)
            doc, number, start, length = cut(np.diff(at), capacity)
            first = at[doc] + start
            crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + length).tolist())), np.int64, len(doc))
            columns = [batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(number, pa.int32()), *map(pa.array, (start, length, crc, np.zeros(len(doc), np.int64)))]
            waiting.append(pa.StructArray.from_arrays(columns, names=[n for n, _ in _PIECE]))
            held += len(doc)
            if held >= LOCAL_PIECES:
                yield from _parts(pack())
        if held:
            yield from _parts(pack())

    return run


def _merge(level: int, capacity: int, slack: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        items = table.sort_by("sequence_id").combine_chunks()
        bins = best_fit(items.column("used").to_numpy(), capacity)
        lists = items.column("pieces").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        inside = np.repeat(bins, lists.value_lengths().to_numpy())
        return pa.Table.from_batches([_bins(lists.flatten(), inside, group, (level << 55) + (group << 24), capacity, slack)])

    return run


def pack(
    docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, slack: int = 8, group_bins: int = 100_000, levels: int = 40
) -> DataFrame:
    """Layout of all documents: one row per piece with ``sequence_id`` and ``offset``."""
    schema = BINS
    counts = None
    level = stored(map_texts(docs.select("doc_id", "text"), _local(tokenizer, capacity, end_id, slack), schema), "pack-0")
    finished, open_bins = [level.where("done")], level.where("not done")
    for depth in range(1, levels + 1):
        counts = open_bins.agg(F.count("*").alias("n"), F.count_distinct("grp").alias("g"), F.max("grp").alias("top")).first()
        if counts.n <= 1 or (depth > 1 and (before - counts.n) * 100 < before):
            break
        if depth > 1 and counts.g == 1:
            break
        before = counts.n
        fan_in = max(2, group_bins * counts.g // counts.n) if counts.g > 1 else counts.top + 1
        merged = open_bins.withColumn("grp", F.floor(F.col("grp") / fan_in))
        level = stored(merged.groupBy("grp").applyInArrow(_merge(depth, capacity, slack), schema), f"pack-{depth}")
        finished.append(level.where("done"))
        open_bins = level.where("not done")
    if counts and counts.g > 1:
        half = F.col("used") * 2 <= capacity
        finished.append(open_bins.where(~half))
        last = open_bins.where(half).withColumn("grp", F.lit(0).cast("bigint"))
        open_bins = stored(last.groupBy("grp").applyInArrow(_merge(levels + 1, capacity, slack), schema), "pack-last")
    everything = open_bins
    for part in finished:
        everything = everything.unionByName(part)
    return everything.select("sequence_id", F.inline("pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
