"""Token ids as binary files: fixed-width bit packing with block offsets.

One file per shard, shards in ascending ``doc_id`` order. All numbers are little-endian.

    blocks   ids in ``bits`` bits each, low bits first, each block filled to a whole byte
    index    u64 x (blocks + 1) byte offsets of the blocks, i64 x documents doc_ids, u8 x documents 1 = NULL doc_id,
             u64 x (documents + 1) first id of each document
    footer   4s "FLTB", u16 version 1, u16 bits, u32 ids a block, u64 documents, u64 ids, u64 place of the index

``bits`` is the least number that holds every id of the vocabulary. Any range of ids is read by seeking
to the blocks that hold it, and unpacked in numpy.

Files go to the shared folder through pyarrow's file systems, each attempt under a name of its own. Only
files that the committed manifest (a Parquet table) lists count, so a task that runs twice or a lost
executor leaves at most an unlisted file.

Edge cases: a NULL or empty text holds the end id only; NULL doc_ids come first; rows with an equal
``doc_id`` are all kept, ordered by text; an empty table gives a manifest without rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.tables import blocks, fresh_path, map_texts, partitions, stored
from fleetlens.llm.tokens import encoder

MAGIC, FOOTER = b"FLTB", struct.Struct("<4sHHIQQQ")
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` low bits of each id, one after the other."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(rows, bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    place = (first + np.arange(count, dtype=np.uint64)) * np.uint64(bits)
    body = np.frombuffer(data + bytes(8), np.uint8)
    byte, value = (place >> np.uint64(3)).astype(np.int64), np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        value |= body[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (place & np.uint64(7))) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


class Writer:
    """Appends documents to one file; holds one open block of ids and the index in memory."""

    def __init__(self, uri: str, vocabulary: int, block_ids: int = 65_536):
        self.fs, self.path = open_folder(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}.blocks")
        self.bits, self.block_ids = bits_for(vocabulary), block_ids
        self.open, self.block_bytes, self.ends, self.doc_ids, self.nulls = np.zeros(0, np.uint32), [0], [np.zeros(1, np.int64)], [], []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)
        self.ends.append(self.ends[-1][-1] + at[1:])
        self.open = np.concatenate([self.open, ids])
        whole = len(self.open) // self.block_ids * self.block_ids
        for i in range(0, whole, self.block_ids):
            self._block(self.open[i : i + self.block_ids])
        self.open = self.open[whole:]

    def _block(self, ids: np.ndarray) -> None:
        self.out.write(data := pack_bits(ids, self.bits))
        self.block_bytes.append(self.block_bytes[-1] + len(data))

    def close(self) -> tuple[int, int]:
        """Write the rest, the index and the footer; returns documents and ids."""
        if len(self.open):
            self._block(self.open)
        ends = np.concatenate(self.ends).astype("<u8")
        docs = np.concatenate([np.zeros(0, np.int64), *self.doc_ids]).astype("<i8")
        nulls = np.concatenate([np.zeros(0, np.uint8), *self.nulls]).astype(np.uint8)
        self.out.write(np.array(self.block_bytes, "<u8").tobytes() + docs.tobytes() + nulls.tobytes() + ends.tobytes())
        self.out.write(FOOTER.pack(MAGIC, 1, self.bits, self.block_ids, len(docs), int(ends[-1]), self.block_bytes[-1]))
        self.out.close()
        self.fs.move(f"{self.path}.blocks", self.path)
        return len(docs), int(ends[-1])


class Reader:
    """Random access to one file. The footer stands at the end, so that a file is written in one pass."""

    def __init__(self, uri: str):
        fs, path = open_folder(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, version, self.bits, self.block_ids, n_docs, self.n_ids, index = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{uri} is no token file")
        n_blocks = -(-self.n_ids // self.block_ids)
        parts = np.cumsum([index, 8 * (n_blocks + 1), 8 * n_docs, n_docs, 8 * (n_docs + 1)]).tolist()
        read = [self._at(a, b - a) for a, b in zip(parts, parts[1:])]
        self.block_bytes, self.doc_ids, self.nulls, self.starts = (np.frombuffer(r, t) for r, t in zip(read, ("<u8", "<i8", np.uint8, "<u8")))

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) of the file; reads only the blocks that hold them."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block_ids, -(-last // self.block_ids)
        data = self._at(int(self.block_bytes[a]), int(self.block_bytes[b] - self.block_bytes[a]))
        if self.block_ids * self.bits % 8 == 0:
            return unpack_bits(data, self.bits, first - a * self.block_ids, last - first)
        found = []
        for k in range(a, b):
            lo, hi = max(first, k * self.block_ids), min(last, (k + 1) * self.block_ids)
            own = data[int(self.block_bytes[k] - self.block_bytes[a]) : int(self.block_bytes[k + 1] - self.block_bytes[a])]
            found.append(unpack_bits(own, self.bits, lo - k * self.block_ids, hi - lo))
        return np.concatenate(found)

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.starts[number]), int(self.starts[number + 1]))


def _write(tokenizer: str, folder: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, out = encoder(tokenizer), TaskContext.get().partitionId(), None
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        for batch, texts in blocks(batches):
            out = out or Writer(uri, coder.vocabulary, block_ids)
            ids, at = coder.encode(texts, end_id)
            doc_ids = batch.column("doc_id").cast(pa.int64())
            out.add(doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().cast(pa.uint8()).to_numpy(), ids, at)
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_ids": [n_ids]})

    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 1, block_ids: int = 65_536, shards: int | None = None) -> DataFrame:
    """Write all documents to token files in ``folder`` and return the stored manifest, one row per file.

    ``shards`` defaults to the session's number of shuffle partitions. The documents are shuffled once,
    by ranges of ``doc_id``, and sorted inside each shard.
    """
    n = shards or partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(map_texts(ordered, _write(tokenizer, folder, end_id, block_ids), MANIFEST), "ids-manifest")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            file = Reader(path)
            starts, step = file.starts.astype(np.int64), 4 << 20
            first = 0
            while first < len(file.doc_ids):
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + step, "right")) - 1)
                ids = file.ids(int(starts[first]), int(starts[last]))
                at = starts[first : last + 1] - starts[first]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(file.doc_ids[first:last], pa.int64(), mask=file.nulls[first:last].astype(bool)),
                        "start": pa.array(base + starts[first:last]),
                        "n_tokens": pa.array(np.diff(at)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )
                first = last


def read_digest(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ids before it in the whole corpus, its ids and their crc32.

    The running total is over one row per file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = placed.repartition(partitions(manifest.sparkSession), "shard")
    return spread.select("path", "base").mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def ids_folder(docs: DataFrame) -> str:
    return fresh_path(docs.sparkSession, "ids")
