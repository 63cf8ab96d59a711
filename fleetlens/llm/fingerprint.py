"""Lempel-Ziv phrase fingerprints: texts that compress alike have alike phrase sets.

A text is cut into symbols (at most eight characters that are no white space, with one white space
after them) and parsed into LZ78 phrases over these: the longest phrase known so far and one symbol more.
The phrases' characters are hashed; the hash space is cut into ``BINS`` ranges and the least hash of each
range, 16 bits of it, is the signature (minimum hash over one permutation). The likeness of two
signatures is the share of equal ranges among those that are not empty in both: an estimate of the Jaccard similarity of the phrase sets.

``neighbours`` compares every document with its successor in descending ``doc_id`` and with an edit that takes half
of its text from the successor. The documents are shuffled once, by ranges of ``doc_id`` cut at ids that
occur. The row at a cut goes to both sides, so that each range holds the successor of its last row, and
the topmost row also closes the lowest range. Inside a range the rows are read in order; only the row
before is held.

Edge cases: a NULL or empty text has no phrases and the fingerprint of empty ranges only; two such
fingerprints are alike (1), one such and another are not (0); rows with an equal ``doc_id`` are ordered by
text; a NULL ``doc_id`` comes last; a single row is its own successor; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import map_texts, mixed, partitions

BINS, EMPTY = 128, 0xFFFF
_SYMBOLS = re.compile(r"\S{1,8}\s?|\s").findall
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_LOWEST = -(1 << 63)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash factor and of its inverse, modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        _powers = tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, f, np.uint64)), dtype=np.uint64) for f in (_FACTOR, _INVERSE))
    return _powers


def parse(symbols: list[str], known: set[str], phrase: str) -> tuple[list[int], str]:
    """Continue an LZ78 parse: lengths of the phrases that close, and the open phrase."""
    lengths = []
    learn, close = known.add, lengths.append
    for symbol in symbols:
        phrase += symbol
        if phrase not in known:
            learn(phrase)
            close(len(phrase))
            phrase = ""
    return lengths, phrase


def signature(text: str, lengths: list[int]) -> np.ndarray:
    """Least hashes of the phrases of ``text`` with these lengths (what is left is the last phrase)."""
    out = np.full(BINS, EMPTY, np.uint16)
    n = len(text)
    if not n:
        return out
    stops = np.cumsum(np.array(lengths, np.int64))
    if not len(stops) or stops[-1] != n:
        stops = np.append(stops, n)
    starts = np.concatenate([[0], stops[:-1]])
    up, down = powers(n)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * up[:n])])
    h = mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    h.sort()
    bins = (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = np.minimum((h[first] >> np.uint64(20)) & np.uint64(0xFFFF), np.uint64(EMPTY - 1)).astype(np.uint16)
    return out


def fingerprint(text: str) -> np.ndarray:
    return signature(text, parse(_SYMBOLS(text), set(), "")[0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != EMPTY) | (b != EMPTY)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


def to_text(print_: np.ndarray) -> str:
    return print_.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both(text: str, following: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Fingerprint, edited text and its fingerprint; what both texts begin with is parsed once."""
    new = edited(text, following)
    kept = len(text) - len(text) // 2
    head = _SYMBOLS(text, 0, kept)
    if head:  # a symbol that ends at the cut may go on
        kept -= len(head.pop())
    known: set[str] = set()
    lengths, phrase = parse(head, known, "")
    own, _ = parse(_SYMBOLS(text, kept), set(known), phrase)
    other, _ = parse(_SYMBOLS(new, kept), known, phrase)
    return signature(text, lengths + own), new, signature(new, lengths + other)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and fingerprint of every row, where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [to_text(fingerprint(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "fingerprint": pa.array(prints, pa.string())})

    return map_texts(docs.select("doc_id", "text"), run, "doc_id bigint, fingerprint string")


COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order, each range closed by its successor row (``ahead``)."""
    names = [c.split()[0] for c in COMPARED.split(", ")]
    before: tuple | None = None
    waiting: tuple | None = None  # compared with its edit, not yet with its successor
    out: list[tuple] = []

    def finish(done: tuple, nearest: np.ndarray) -> None:
        doc_id, text, own, new, own_new = done
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc_id, len(text), digest, to_text(own), to_text(own_new), likeness(own, own_new), likeness(own, nearest)))

    def flush() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out)]
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for part, ahead, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")]):
            text = text or ""
            if before is not None and before[0] == part:
                own, new, own_new = both(before[2], text)
                if waiting is not None:
                    finish(waiting, own)
                waiting = (before[1], before[2], own, new, own_new)
                if ahead:
                    finish(waiting, fingerprint(text))
                    waiting = None
            before = None if ahead else (part, doc_id, text)
            if len(out) >= 1000:
                yield flush()
    if out:
        yield flush()


def neighbours(docs: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """Every document against its edit and its successor in descending ``doc_id``.

    ``ranges`` (default: four per shuffle partition) is the number of ``doc_id`` ranges.
    """
    spark = docs.sparkSession
    n = ranges or 4 * partitions(spark)
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LOWEST)).cast("bigint").alias("key"))
    marks = keyed.agg(
        F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("cuts"), F.max("key").alias("top")
    ).first() if n > 1 else keyed.agg(F.array().cast("array<bigint>").alias("cuts"), F.max("key").alias("top")).first()
    cuts = np.unique(np.array([c for c in marks.cuts or [] if c < marks.top], np.int64))
    top = marks.top

    @F.pandas_udf("array<bigint>")
    def places(key):
        """Twice the range of a row, plus 1 where the row only closes the range."""
        keys = key.to_numpy()
        own, below = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
        rows = [[2 * p, 2 * q + 1] if q != p else [2 * p] for p, q in zip(own.tolist(), below.tolist())]
        for i in np.flatnonzero(keys == top).tolist():
            rows[i] = [*rows[i], 1]
        return type(key)(rows)

    spread = keyed.withColumn("at", F.explode(places("key"))).select(
        "doc_id", "text", "key", F.floor(F.col("at") / 2).alias("part"), (F.col("at") % 2 == 1).alias("ahead")
    )
    dealt = spread.repartitionById(partitions(spark), F.pmod("part", F.lit(partitions(spark))).cast("int")).sortWithinPartitions("part", "ahead", F.desc("key"), "text")
    return map_texts(dealt.select("part", "ahead", "doc_id", "text"), _compare, COMPARED)
