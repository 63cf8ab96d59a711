"""Toxicity classifier, regularised by counterfactuals: swapping identity terms must not change a score.

A text is cut into sentences (at ``.``, ``!``, ``?`` and line ends). A sentence's score is linear in its distinct words and their
beginnings of 4, 5 and 6 bytes, hashed to ``BUCKETS``; a text is as toxic as its worst sentence. ``fit`` learns from labels of texts, so
the sentence that counts is found along with the weights. Its loss has three parts: the log loss of the texts, a ridge, and
``balance`` times the mean squared change of a sentence's score when an identity term in it is swapped for others
of its group. A group that is mentioned in toxic texts more often than its fellows then gains no weight by itself: what it
would gain is shared by all of the group, and their neutral mentions, which are in texts of label 0, take it away.

``fit`` reads about ``train_docs`` labelled documents per class, a hash sample, none longer than ``TRAIN_BYTES``, and at most ``4 * train_docs``
different texts of them (rows may share a ``doc_id``): ``4 * train_docs * TRAIN_BYTES`` bytes bound what reaches the driver (about 2 % of that on usual texts). The bias is moved to the true share of the classes.

Scoring needs no shuffle. Texts are worked on in pieces of ``PIECE_BYTES``, cut after a sentence's end where there is one.

Edge cases: NULL, empty and wordless texts get the score of a sentence without words; labels other than 0 and 1, and NULL labels, are not
learned; of several labels for one ``doc_id`` the largest counts; with one class only (or none) every score is that class's share
(or 0.5); equal texts have equal scores and count once in ``fit`` (toxic if one of them is); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fleetlens.llm.tables import blocks, bytes_of, map_texts, mixed

BUCKETS, PIECE_BYTES, TRAIN_BYTES = 1 << 20, 1 << 20, 32_768
#: Terms of one group stand for each other. Lower case; a term is one word.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("american", "german", "french", "spanish", "mexican", "chinese", "indian", "african", "russian", "turkish", "polish"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("deutsche", "türken", "polen", "franzosen"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_BEGINNINGS = (4, 5, 6)
FEATURES = 1 + len(_BEGINNINGS)

#: 0 white space and marks, 1 parts of words, 2 ends of sentences.
_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[[10, 13, 33, 46, 63]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(body: np.ndarray) -> np.ndarray:
    """Bytes with the capitals of ASCII and Latin-1 (as UTF-8) in lower case."""
    out = _LOWER[body]
    capital = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)) + 1
    out[capital] += 32
    return out


@dataclass
class Words:
    """Distinct words of the sentences of some texts: hashes of the whole words, features, and where sentences and texts begin among them."""

    whole: np.ndarray  # uint64
    features: np.ndarray  # (words, FEATURES) buckets; 0 is no feature
    sentences: np.ndarray  # first word of each sentence that has words
    texts: np.ndarray  # first sentence of each text, one more at the end


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def word_features(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole words and buckets, from the first and last eight bytes (as numbers) and the sizes of words."""
    with np.errstate(over="ignore"):
        whole = mixed(mixed(first + np.uint64(1)) + mixed(last + np.uint64(2)) + size.astype(np.uint64))
        columns = [_bucket(whole)]
        for k in _BEGINNINGS:
            begun = mixed((first & _MASKS[k]) + np.uint64(k << 56) + np.uint64(3))
            columns.append(np.where(size > k, _bucket(begun), 0))
    return whole, np.stack(columns, axis=1)


def words_of(body: np.ndarray, at: np.ndarray) -> Words:
    """The words of the texts ``body[at[i] : at[i + 1]]``."""
    low = np.concatenate([lowered(body), np.zeros(8, np.uint8)]) if len(body) else np.zeros(8, np.uint8)
    kind = _KIND[body]
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = kind == 1
    edge = inside[1:] != inside[:-1]
    edge[at[(at > 0) & (at < len(body))]] |= inside[1:][at[(at > 0) & (at < len(body))]]
    starts = np.flatnonzero(edge[: len(body)] & inside[1:-1])
    # a word ends where the next part begins that is no word, or at the end of its text
    last = np.zeros(len(body) + 1, bool)
    last[at] = True
    ends_of = np.flatnonzero(inside[1:-1] & (~inside[2:] | last[1:])) + 1
    size = ends_of - starts
    eight = np.ndarray((len(low) - 7,), "<u8", buffer=low.tobytes(), strides=(1,))
    mask = _MASKS[np.minimum(size, 8)]
    whole, features = word_features(eight[starts] & mask, eight[np.maximum(ends_of - 8, starts)] & mask, size)
    closed = np.concatenate([[0], np.cumsum(kind == 2)])[starts]
    text = np.searchsorted(at, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (closed[1:] != closed[:-1]) | (text[1:] != text[:-1])
    with np.errstate(over="ignore"):
        _, once = np.unique(mixed(whole + np.cumsum(new).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    once.sort()  # the first of equal words of a sentence
    sentences = np.flatnonzero(new[once])
    return Words(whole[once], features[once], sentences, np.searchsorted(text[once][sentences], np.arange(len(at))))


def words_of_all(body: np.ndarray, at: np.ndarray) -> Words:
    """``words_of`` for many texts, some at a time, so that what it needs beside its result is small."""
    parts, first = [], 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, "right")) - 1)
        parts.append(words_of(body[at[first] : at[last]], at[first : last + 1] - at[first]))
        first = last
    words = np.cumsum([0, *(len(p.whole) for p in parts)])
    sentences = np.cumsum([0, *(len(p.sentences) for p in parts)])
    return Words(
        np.concatenate([p.whole for p in parts]),
        np.concatenate([p.features for p in parts]),
        np.concatenate([p.sentences + w for p, w in zip(parts, words)]),
        np.concatenate([*(p.texts[:-1] + s for p, s in zip(parts, sentences)), sentences[-1:]]),
    )


def pieces(body: np.ndarray, at: np.ndarray, limit: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of pieces of at most ``limit`` bytes (cut after a sentence's end, else after a word's), and the text of each."""
    bounds, text = [0], []
    for i in range(len(at) - 1):
        start, end = int(at[i]), int(at[i + 1])
        while end - start > limit:
            for least in (2, 0):
                good = np.flatnonzero(_KIND[body[start : start + limit]] == least)
                if len(good):
                    break
            start += int(good[-1]) + 1 if len(good) else limit
            bounds.append(start)
            text.append(i)
        bounds.append(end)
        text.append(i)
    return np.array(bounds, np.int64), np.array(text, np.int64)


def _sums(weights: np.ndarray, features: np.ndarray, sentences: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Sum of the weights of each sentence's words."""
    if not len(sentences):
        return np.zeros(0)
    by_word = np.empty(len(features))
    for first in range(0, len(features), step):
        by_word[first : first + step] = weights[features[first : first + step]].sum(axis=1, dtype=np.float64)
    return np.add.reduceat(by_word, sentences)


@dataclass
class Classifier:
    weights: np.ndarray  # (BUCKETS,)
    bias: float

    def worst(self, words: Words) -> np.ndarray:
        """For each text the largest sum of a sentence's weights; -inf without words."""
        sums = _sums(self.weights, words.features, words.sentences)
        out = np.full(len(words.texts) - 1, -np.inf)
        full = np.flatnonzero(np.diff(words.texts))
        if len(full):
            out[full] = np.maximum.reduceat(sums, words.texts[full])
        return out

    def scores(self, texts: pa.LargeStringArray) -> np.ndarray:
        body, at = bytes_of(texts)
        bounds, text = pieces(body, at)
        best = np.full(len(texts), -np.inf)
        first = 0
        while first < len(text):  # pieces of about PIECE_BYTES together
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PIECE_BYTES, "right")) - 1)
            part = body[bounds[first] : bounds[last]]
            np.maximum.at(best, text[first:last], self.worst(words_of(part, bounds[first : last + 1] - bounds[first])))
            first = last
        z = np.where(np.isneginf(best), 0.0, best) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def swaps(words: Words, groups: Sequence[Sequence[str]], most: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counterfactuals of sentences: (features that go, features that come, sentence), a row per changed word.

    Every identity term of a sentence is swapped for its group's next term and for the last one, one word at a time, in at most
    ``most`` places (evenly spread).
    """
    terms = [(term, group[(i + step) % len(group)]) for group in groups for i, term in enumerate(group) for step in sorted({1, len(group) - 1}) if len(group) > 1]
    none = np.zeros((0, FEATURES), np.int32)
    if not terms or not len(words.whole):
        return none, none, np.zeros(0, np.int64)
    own, own_features = encoded([a for a, _ in terms])
    _, other_features = encoded([b for _, b in terms])
    order = np.argsort(own, kind="stable")
    left = np.searchsorted(own[order], words.whole)
    right = np.searchsorted(own[order], words.whole, "right")
    place = np.repeat(np.arange(len(words.whole)), right - left)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)
    term = order[left[place] + nth]
    if len(place) > most:
        chosen = np.linspace(0, len(place) - 1, most).astype(np.int64)
        place, term = place[chosen], term[chosen]
    return own_features[term], other_features[term], np.searchsorted(words.sentences, place, "right") - 1


def encoded(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and features of single words."""
    body, at = bytes_of(pa.array(list(words), pa.large_string()))
    found = words_of(body, at)
    if len(found.whole) != len(words):
        raise ValueError("an identity term must be one word")
    return found.whole, found.features


def train(words: Words, label: np.ndarray, share: float, *, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, balance: float = 1.0, ridge: float = 1e-5, epochs: int = 40, rate: float = 0.3) -> Classifier:
    """Adagrad on the whole sample. Weights start at the log odds of features that are plainly more frequent in toxic texts."""
    texts = len(label)
    full = np.flatnonzero(np.diff(words.texts))
    sentence_text = np.repeat(np.arange(texts), np.diff(words.texts))
    gone, came, _ = swaps(words, groups)
    # only the buckets that occur, numbered; 0 stays 0
    occurs = np.zeros(BUCKETS, bool)
    occurs[0] = occurs[words.features] = occurs[came] = True
    number = (np.cumsum(occurs) - 1).astype(np.int32)
    features, gone, came = number[words.features], number[gone], number[came]
    buckets = np.flatnonzero(occurs)
    n = len(buckets)
    ones, zeros = np.zeros(n), np.zeros(n)
    ends = np.append(words.sentences[1:], len(words.whole))
    for first in range(0, texts, 500):  # features of texts, some texts at a time
        sentences = slice(words.texts[first], words.texts[min(texts, first + 500)])
        if sentences.start == sentences.stop:
            continue
        own = slice(words.sentences[sentences.start], ends[sentences.stop - 1])
        text = np.repeat(sentence_text[sentences], ends[sentences] - words.sentences[sentences])
        seen = np.unique(text[:, None] * n + features[own])
        bad = label[seen // n] == 1
        ones += np.bincount(seen[bad] % n, minlength=n)
        zeros += np.bincount(seen[~bad] % n, minlength=n)
    n1, n0 = label.sum(), texts - label.sum()
    odds = np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros + 0.5) / (n0 + 1))
    weights = np.where((ones > 1) & (odds > 1.5), odds / FEATURES, 0.0)
    weights[0] = 0.0
    bias, squares, bias_square = -2.0, np.full(n, 1e-2), 1e-2
    for _ in range(epochs):
        sums = _sums(weights, features, words.sentences)
        z = np.full(texts, bias)
        top = np.maximum.reduceat(sums, words.texts[full]) if len(full) else np.zeros(0)
        z[full] += top
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / texts
        # the first of the worst sentences of each text
        is_top = np.flatnonzero(sums == np.repeat(top, np.diff(words.texts)[full]))
        _, which = np.unique(sentence_text[is_top], return_index=True)
        chosen = is_top[which]
        sizes = ends[chosen] - words.sentences[chosen]
        rows = np.repeat(words.sentences[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        gradient = np.bincount(features[rows].ravel(), np.repeat(error[sentence_text[chosen]], sizes * FEATURES), n)
        if len(gone):
            change = weights[gone].sum(axis=1) - weights[came].sum(axis=1)
            pull = np.repeat(2 * balance * change / len(gone), FEATURES)
            gradient += np.bincount(gone.ravel(), pull, n) - np.bincount(came.ravel(), pull, n)
        gradient += ridge * weights / max(1, n1)
        gradient[0] = 0.0
        squares += gradient * gradient * texts
        weights = np.maximum(weights - rate * gradient * np.sqrt(texts) / np.sqrt(squares), 0)
        slope = error.sum()
        bias_square += slope * slope * texts
        bias -= rate * slope * np.sqrt(texts) / np.sqrt(bias_square)
    own = np.clip(label.mean(), 1e-6, 1 - 1e-6)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    shift = np.log(share / (1 - share)) - np.log(own / (1 - own))
    whole = np.zeros(BUCKETS, np.float32)
    whole[buckets] = weights
    return Classifier(whole, float(bias + shift))


def constant(share: float) -> Classifier:
    """Every text gets the same score."""
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return Classifier(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, *, train_fold: Column, train_docs: int = 2500, **options) -> Classifier:
    """Learn from the labelled rows where ``train_fold`` (over ``doc_id``) holds."""
    usable = labels.where(train_fold & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_class = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    total = sum(by_class.values())
    if len(by_class) < 2:
        return constant(by_class.get(1, 0) / total if total else 0.5)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, train_docs / by_class[1]))).otherwise(F.lit(min(1.0, train_docs / by_class[0])))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) < share * float(1 << 30))
    # about 2 * train_docs narrow rows; only their texts move, and copies are one
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).where(F.octet_length(text) <= TRAIN_BYTES).join(F.broadcast(sample), "doc_id")
    distinct = found.groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = sorted((r.text, r.toxic) for r in distinct.orderBy(F.xxhash64("text"), "text").limit(4 * train_docs).collect())
    if len({y for _, y in rows}) < 2:
        return constant(by_class[1] / total)
    body, at = bytes_of(pa.array([t for t, _ in rows], pa.large_string()))
    label = np.array([y for _, y in rows], np.float64)
    del rows
    return train(words_of_all(body, at), label, by_class[1] / total, **options)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """All columns of ``docs`` (a clashing ``score`` is replaced) and the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    kept = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            scores = pa.array(shared.value.scores(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    return map_texts(kept, run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
