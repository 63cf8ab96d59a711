"""Token ids of many texts, with the tokenizers library called once per distinct piece of text.

Both public vocabularies used here cut a text before white space that follows another character and
between an ASCII letter and an ASCII digit or mark, and nothing on one side of such a cut changes the
ids on the other. A block of texts is therefore
cut there (in numpy, on the UTF-8 bytes), the distinct pieces are encoded by the library, and the
ids of the texts are gathered from the pieces' ids. A cut is not made where the character before it
may be white space outside ASCII.

Literals of added tokens (such as ``<|endoftext|>``) in a text are those tokens, as the library has it with ``add_special_tokens=False``: it
cuts a text around them before anything else, and so does ``pieces``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from fleetlens.llm.tables import blocks, bytes_of, map_texts

#: Classes of bytes: 0 ASCII letter, 1 other visible ASCII, 2 ASCII white space, 3 everything else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[33:127] = 1
_CLASS[65:91] = _CLASS[97:123] = 0
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
#: By 4 * class of the byte before + class of the byte after.
_CUT = np.zeros(16, bool)
_CUT[[0 * 4 + 1, 0 * 4 + 2, 1 * 4 + 2, 3 * 4 + 2]] = True


def pieces(texts: pa.LargeStringArray, literals: re.Pattern[bytes] | None = None) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Contiguous pieces of the texts, and for each text the number of its first piece (one more at the end).

    Matches of ``literals`` are pieces of their own.
    """
    body, at = bytes_of(texts)
    kind = _CLASS[body]
    flags = np.zeros(len(body) + 1, bool)
    if len(body):
        flags[1:-1] = _CUT[kind[:-1] * np.uint8(4) + kind[1:]]
        wide = np.flatnonzero(flags[1:-1] & (kind[:-1] == 3)) + 1
        last, second, third = body[wide - 1], body[np.maximum(wide - 2, 0)], body[np.maximum(wide - 3, 0)]
        blank = ((second == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3))
        flags[wide[blank]] = False
    flags[at] = True
    for match in literals.finditer(body.data) if literals is not None and len(body) else ():
        first, last = match.span()
        if np.searchsorted(at, first, "right") == np.searchsorted(at, last, "left"):  # inside one text
            flags[first + 1 : last] = False
            flags[[first, last]] = True
    bounds = np.flatnonzero(flags)
    buffer = pa.py_buffer(np.ascontiguousarray(body)) if len(body) else pa.py_buffer(b"")
    segments = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), buffer)
    return segments, np.searchsorted(bounds, at)


class Encoder:
    """Ids of texts by a tokenizer file; remembers at most ``limit`` pieces."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.literals = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.limit = limit
        suffix = self.tokenizer.model.end_of_word_suffix
        self.closes = bool(suffix)
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab().items() if (t.endswith(suffix) if suffix else t[0] == "\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _rows(self, distinct: list[str]) -> np.ndarray:
        if len(self.rows) > self.limit:
            self._forget()
        known = self.rows
        found = np.fromiter((known.get(s, -1) for s in distinct), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            base, missing = len(known), [distinct[i] for i in new]
            known.update(zip(missing, range(base, base + len(new))))
            found[new] = np.arange(base, base + len(new))
            words = np.fromiter((s[0] == " " and s[1:].isalpha() for s in missing), bool, len(missing))
            flat, sizes = self._words([s for s, w in zip(missing, words) if w])
            more, more_sizes = self._singly([s for s, w in zip(missing, words) if not w])
            size = np.zeros(len(missing), np.int64)
            start = np.zeros(len(missing), np.int64)
            size[words], size[~words] = sizes, more_sizes
            start[words] = np.cumsum(sizes) - sizes
            start[~words] = len(flat) + np.cumsum(more_sizes) - more_sizes
            self.starts = np.concatenate([self.starts, len(self.flat) + start])
            self.sizes = np.concatenate([self.sizes, size])
            self.flat = np.concatenate([self.flat, flat, more])
        return found

    def _singly(self, missing: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.array([i for ids in coded for i in ids], np.uint32), sizes

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one space and letters, as one text: an id that opens (or closes) a word tells them apart."""
        if not words:
            return self._singly(words)
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            return self._singly(words)
        if self.closes:
            return ids, np.diff(edges, prepend=-1)
        return ids, np.diff(edges, append=len(ids))

    def encode(self, texts: pa.LargeStringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one text after the other, and the texts' offsets; ``end_id`` closes each text."""
        segments, first = pieces(texts, self.literals)
        coded = segments.dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes, starts = self.sizes[rows], self.starts[rows]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(starts - before[:-1], sizes) + np.arange(before[-1])]
        at = before[first]
        if end_id is None:
            return ids, at
        return np.insert(ids, at[1:], end_id).astype(np.uint32, copy=False), at + np.arange(len(at))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def with_counts(docs: DataFrame, paths: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with a column of token counts for each name in ``paths``. NULL and empty texts have no tokens."""
    kept = docs.drop(*paths)
    fields = StructType([*(f for f in kept.schema.fields if f.name != text), *(StructField(name, LongType()) for name in paths)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text):
            counts = [pa.array(np.diff(encoder(path).encode(texts)[1]), pa.int64()) for path in paths.values()]
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=fields.names)

    return map_texts(kept, run, fields)
