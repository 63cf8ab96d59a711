"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one row per position and one bit per language. An n-gram's ``hashes`` rows, ANDed,
give the mask of all languages whose filter contains it, in one look-up for all languages at once. Over a
text, the set bits are counted per language; with f the share of set bits of a language's slice, f ** hashes
of the n-grams that are not in the filter count all the same, which the corrected count takes off:
(hits - n * f**k) / (1 - f**k). The language with the highest corrected count wins (ties: more training
documents, then the name), and its share of all corrected counts is the score.

N-grams are four code points of the lower-cased text with everything but letters as a gap, and the two inner
ones letters. Filters hold the ``grams`` most frequent n-grams of each language, counted by Spark in a hash sample of
about ``train_docs`` documents per language; only the filter rows (at most the ``positions`` of the filter) reach the driver.

Edge cases: NULL texts and texts without a letter are ``und`` with score 0; a text with letters but no n-gram
(only one-letter words), or none that any filter knows, gets the language with the most training documents and
its share of them; without any training document every text is ``und``; further columns are ignored; rows
with an equal ``doc_id`` are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.tables import blocks, map_texts, mixed, stored

UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter, by Python's rule for all of them."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the text of each, and whether each text has a letter."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\0\0\0\0".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = 4 + np.cumsum([len(t) + 4 for t in lowered])
    is_letter = letters()[points]
    seen = np.add.reduceat(is_letter, np.concatenate([[0], ends[:-1]])) > 0 if len(points) else np.zeros(len(texts), bool)
    code = np.where(is_letter, points, 0).astype(np.uint64)
    inner = np.flatnonzero(is_letter[1:-2] & is_letter[2:-1]) if len(points) > 3 else np.zeros(0, np.int64)
    h = ((code[inner] * np.uint64(1 << 21) + code[inner + 1]) * np.uint64(0x9E3779B97F4A7C15)) ^ (
        (code[inner + 2] * np.uint64(1 << 21) + code[inner + 3]) * np.uint64(0xC2B2AE3D27D4EB4F)
    )
    return mixed(h), np.searchsorted(ends, inner + 1, "right"), seen


@dataclass
class Filters:
    """The bit-sliced filter: ``rows`` is (positions, words) of uint64 masks, one bit per language."""

    languages: list[str]
    priors: np.ndarray
    rows: np.ndarray
    hashes: int

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        size = np.uint64(len(self.rows) - 1)
        return [((h >> np.uint64(21 * k)) & size).astype(np.int64) for k in range(self.hashes)]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: hits by language, n-grams, whether it has a letter."""
        h, text, seen = grams_of(texts)
        n = np.bincount(text, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)), np.int64)
        places = self._places(h)
        for word in range(self.rows.shape[1]):
            column = np.ascontiguousarray(self.rows[:, word])
            mask = column[places[0]]
            for place in places[1:]:
                mask &= column[place]
            for bit, language in enumerate(range(word * 64, min(len(self.languages), word * 64 + 64))):
                hits[:, language] = np.bincount(text[(mask >> np.uint64(bit)) & np.uint64(1) == 1], minlength=len(texts))
        return hits, n, seen

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        hits, n, seen = self.counts(texts)
        wrong = self.fill() ** self.hashes
        corrected = np.maximum(0.0, (hits - n[:, None] * wrong) / np.maximum(1e-9, 1 - wrong))
        total = corrected.sum(axis=1)
        best = corrected.argmax(axis=1)
        score = np.where(total > 0, corrected[np.arange(len(texts)), best] / np.maximum(total, 1e-12), self.priors[0])
        best = np.where(total > 0, best, 0)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, seen)], np.where(seen, score, 0.0)

    def fill(self) -> np.ndarray:
        """Share of set bits of each language's slice."""
        bits = [(self.rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(self.languages))]
        return np.array([b.mean() for b in bits])


def _count(languages: list[str]):
    index = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            h, text, _ = grams_of(texts.to_pylist())
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)[text]
            for i in np.unique(lang):
                grams, n = np.unique(h[lang == i], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(n), i), pa.int32()), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n)})

    return run


def fit(docs: DataFrame, *, train: Column, train_docs: int = 1500, grams: int = 20_000, positions: int = 1 << 18, hashes: int = 3, max_languages: int = 4096) -> Filters:
    """Learn the filters from the rows of ``docs`` where ``train`` holds and text and lang are known.

    ``train_docs`` bounds the expected number of sampled documents per language; ``max_languages`` guards the
    driver, which gets one row per language (more than that is an error, not a cut).
    """
    known = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages, total = [r.lang for r in sizes], sum(r["count"] for r in sizes)
    rows = np.zeros((positions, max(1, -(-len(languages) // 64))), np.uint64)
    if not languages:
        return Filters([], np.zeros(0), rows, hashes)
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1.0, train_docs / r["count"]))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < share * float(1 << 30))
    counted = map_texts(sample, _count(languages), "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stored(counted, "language-grams")
    # how many n-grams have each count: few rows per language, so that no task ranks a language's n-grams
    steps = counted.groupBy("lang", "n").agg(F.count("*").alias("_ties"))
    above = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_above", F.coalesce(F.sum("_ties").over(above), F.lit(0))).where(F.col("_above") < grams)
    # of the n-grams at the last count a share by their (hashed) value
    room = (F.lit(grams) - F.col("_above")) / F.col("_ties")
    value = F.shiftrightunsigned("gram", 12) / F.lit(float(1 << 52))
    chosen = counted.join(steps, ["lang", "n"]).where(value < room)
    place = F.explode(F.array(*[F.shiftrightunsigned("gram", 21 * k).bitwiseAND(F.lit(positions - 1)) for k in range(hashes)]))
    word = F.floor(F.col("lang") / 64).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, lang % 64)").alias("bit")
    sliced = chosen.select(place.alias("place"), word, bit).groupBy("place", "word").agg(F.bit_or("bit").alias("bits"))
    for r in sliced.toLocalIterator():
        rows[r.place, r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    return Filters(languages, np.array([r["count"] / total for r in sizes]), rows, hashes)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            names, scores = shared.value.predict(texts.to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "lang_pred": names, "score": pa.array(scores, pa.float64())})

    return map_texts(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double")
