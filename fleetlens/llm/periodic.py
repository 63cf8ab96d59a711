"""Periodic runs of words: an online sparse DP over diagonals (lags) of the self-comparison of a text.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least
``max(least, 2 * q)`` words that no neighbouring word extends. On the diagonal of lag q it is a chain of
at least ``max(q, least - q)`` matches. The DP goes through the words in order; every earlier occurrence of what
ends at a word lengthens the match of its lag, and a diagonal that is not lengthened ends: it is
emitted if it is long enough. The state is one length and one last word per active lag.

What makes it sparse: a diagonal of lag q counts only if q words (and ``least / 2``) match, so lags from W to 2 W are driven
by occurrences of W words at a time, for W = 6, 12, 24, ...; numbers of W words are exact (pairs of numbers, told
apart by sorting). Prose that repeats no six words ends there. While the nearest earlier occurrence stays d words away the
text has period d, and the diagonals of the multiples of d inside that stretch start and end with it, so they can
be no runs; they are not entered, which keeps "a a a a ..." linear. Chains whose period has a divisor that is a period, too, are
dropped in the end.

Memory: some arrays as long as the text's words, and pairs in blocks of ``PAIRS``. A text must fit into a
worker several times. Every text is worked on alone, so there is no shuffle.

Edge cases: NULL text: no words, no runs, an empty ``collapsed``; repeated rows are each worked on; columns other than
``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fleetlens.llm.tables import map_texts, mixed

#: Pairs of equal word windows that are held at once.
PAIRS = 1 << 20
_FIELDS = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _numbers(left: np.ndarray, right: np.ndarray, top: int) -> np.ndarray:
    """A number for each pair, equal for equal pairs; -1 for pairs with a -1 and for those that occur once."""
    out = np.full(len(left), -1, np.int64)
    known = np.flatnonzero((left >= 0) & (right >= 0))
    _, number, times = np.unique(left[known] * top + right[known], return_inverse=True, return_counts=True)
    again = times[number] > 1
    out[known[again]] = number[again]
    return out


def _longer(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Numbers of windows, by their last word: a window of ``a`` followed by one of ``b``, which has ``size`` words."""
    out = np.full(len(a), -1, np.int64)
    out[size:] = _numbers(a[:-size], b[size:], len(a) + 1)
    return out


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """For each word the number of the ``size`` words that end there, or -1 if there are none or they occur once."""
    if size == 1:
        return words
    half = windows(words, size // 2)
    whole = _longer(half, half, size // 2)
    return _longer(whole, words, 1) if size % 2 else whole


class Diagonals:
    """The state of the DP: for each lag below ``top`` the last match and the matches in a row."""

    def __init__(self, size: int, top: int, least: int):
        self.size, self.least = size, least
        self.last, self.length = np.full(top, -2, np.int64), np.zeros(top, np.int64)
        self.found: list[np.ndarray] = []

    def _emit(self, lag: np.ndarray, last: np.ndarray, length: np.ndarray) -> None:
        match = length + self.size - 1
        good = (length > 0) & (match >= np.maximum(lag, self.least - lag))
        if good.any():
            lag, last, match = lag[good], last[good], match[good]
            self.found.append(np.stack([last - match + 1 - lag, match + lag, lag], axis=1))

    def extend(self, lag: np.ndarray, word: np.ndarray) -> None:
        """Matches of later words than before, sorted by lag and word."""
        if not len(lag):
            return
        first = np.ones(len(lag), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (word[1:] != word[:-1] + 1)
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(lag))
        own, last, length = lag[start], word[end - 1], end - start
        opens, closes = np.ones(len(own), bool), np.ones(len(own), bool)
        opens[1:] = closes[:-1] = own[1:] != own[:-1]
        goes_on = opens & (self.last[own] == word[start] - 1)
        length = length + np.where(goes_on, self.length[own], 0)
        ended = own[opens & ~goes_on]
        self._emit(ended, self.last[ended], self.length[ended])
        self._emit(own[~closes], last[~closes], length[~closes])
        self.last[own[closes]], self.length[own[closes]] = last[closes], length[closes]

    def end(self, before: int) -> None:
        """Diagonals whose last match is before that word have ended."""
        ended = np.flatnonzero((self.length > 0) & (self.last < before))
        self._emit(ended, self.last[ended], self.length[ended])
        self.length[ended] = 0


def _chains(number: np.ndarray, size: int, low: int, top: int, least: int, pairs: int) -> list[np.ndarray]:
    """Chains (start, length, lag) of the lags from ``low`` to below ``top``, from windows of ``size`` words."""
    n = len(number)
    at = np.flatnonzero(number >= 0)
    order = np.argsort(number[at], kind="stable")
    place, own = at[order], number[at][order]  # by number, then place
    away = np.zeros(len(own), np.int64)
    away[1:] = np.where(own[1:] == own[:-1], place[1:] - place[:-1], 0)
    nearest = np.zeros(n, np.int64)
    nearest[place] = away
    changes = np.ones(n, bool)
    changes[1:] = nearest[1:] != nearest[:-1]
    since = np.maximum.accumulate(np.where(changes, np.arange(n), 0))
    key = own * (n + 1) + place
    base = own * (n + 1)
    # occurrences inside the stretch of period `away` are multiples of it
    until = np.minimum(place - low, since[place] - away - 1)
    left = np.searchsorted(key, base + np.maximum(place - top + 1, 0))
    right = np.searchsorted(key, base + np.maximum(until, -1), "right")
    many = np.where(away > 0, np.maximum(right - left, 0), 0)
    near = (away >= low) & (away < top)
    by_place = np.argsort(place)
    place, away, left, many, near = (v[by_place] for v in (place, away, left, many, near))
    sorted_place = at[order]
    done = np.cumsum(many + near)
    state, first = Diagonals(size, top, least), 0
    while first < len(place):
        start = done[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(done, start + pairs, "right")))
        part = slice(first, last)
        times = many[part]
        word = np.repeat(place[part], times)
        before = np.repeat(left[part] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        closest = near[part]
        lag = np.concatenate([word - sorted_place[before], away[part][closest]])
        word = np.concatenate([word, place[part][closest]])
        by_lag = np.argsort(lag * (n + 1) + word)
        state.extend(lag[by_lag], word[by_lag])
        if last < len(place):
            state.end(place[last] - 1)
        first = last
    state.end(n)
    return state.found


def _primes(q: int) -> Iterator[int]:
    p = 2
    while p * p <= q:
        if q % p == 0:
            yield p
            while q % p == 0:
                q //= p
        p += 1
    if q > 1:
        yield q


def _is_least(words: np.ndarray, start: int, length: int, period: int) -> bool:
    stretch = words[start : start + length]
    return not any(np.array_equal(stretch[period // p :], stretch[: -(period // p)]) for p in _primes(period))


def runs_of(words: np.ndarray, least: int = 12, pairs: int = PAIRS) -> np.ndarray:
    """(start, length, period) of all runs by start and period; equal words have equal numbers below ``len(words)``."""
    n, size, low = len(words), (least + 1) // 2, 1
    none = np.zeros((0, 3), np.int64)
    if n < least or not _repeats(words, size):
        return none
    found, number = [], windows(words, size)
    while 2 * low <= n and (number >= 0).any():
        found += _chains(number, size, low, 2 * size, least, pairs)
        number, low, size = _longer(number, number, size), 2 * size, 2 * size
    if not found:
        return none
    runs = np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]
    return runs[[_is_least(words, *map(int, r)) for r in runs]]


def _repeats(words: np.ndarray, size: int) -> bool:
    """Whether ``size`` words may occur twice (by a hash: never a wrong no)."""
    key = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        key = mixed(key + words[k : k + len(key)].astype(np.uint64) + np.uint64(1))
    key.sort()
    return bool((key[1:] == key[:-1]).any())


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: all but those after the first period of a run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def find_runs(docs: DataFrame, *, text: Column | None = None, least: int = 12) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` by start and period, and ``collapsed``: the text's words, joined by one space,
    without those that repeat the first period of a run. Words are runs of characters other than ASCII white space."""
    rows = docs.select("doc_id", (F.col("text") if text is None else text).alias("text"))
    fields = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL(_FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, collapsed = [], [], []
            for body in batch.column("text").cast(pa.large_binary()):
                words = (body.as_py() or b"").split()
                first: dict[bytes, int] = {}
                numbers = np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))
                runs = runs_of(numbers, least)
                if len(runs):
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
                sizes.append(len(numbers))
                found.append(runs)
                collapsed.append(b" ".join(words))
            flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), parts), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=[f.name for f in fields],
            )

    return map_texts(rows, run, fields)


def longest(runs: str = "runs") -> Column:
    """The longest run; of equal ones the first, then that with the least period. NULL without runs."""
    better = lambda best, r: F.when(best.isNull() | (r.length > best.length), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def listed(runs: str = "runs") -> Column:
    """All runs as lines ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
