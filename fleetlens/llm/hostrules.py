"""Host-level quality rules: failures by host, rates shrunk by an empirical beta prior, verdicts joined back.

Every document is measured once (``measure``): words, their characters, marks, repeated lines and repeated
three-word windows, in numpy over blocks of whole texts; words and lines are told apart by Arrow's
dictionary encoding, so equality is exact. The narrow measures are stored in the shared folder.

Rules judge each document. Failures are summed per (host, rule) before any shuffle. Over all hosts, a beta
prior is fitted per rule by moments that allow for unequal hosts: with n documents and rate p of each of k
hosts, N documents and rate m of all, the share of variance that lies between hosts is
r = (sum n (p - m)^2 / (m (1 - m)) - (k - 1)) / (N - sum n^2 / N - (k - 1)), and the prior weighs 1 / r - 1
pseudo-documents, held within ``weight_bounds``. A host's shrunk rate is
(failures + weight * m) / (documents + weight): a host with one document is judged by the corpus, one
with a million by itself. A host whose shrunk rate of a rule is above ``host_limit`` has a bad
verdict for that rule, and all its documents go. Elsewhere a document goes when it fails ``base`` or a rule by itself.

Edge cases: a NULL or empty text has no words and fails ``base``; a NULL host is a host of its own; rows with an equal
``doc_id`` count each; one host alone, or hosts with equal rates, get the largest weight; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tables import blocks, bytes_of, join_stats, map_texts, mixed, stored

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Marks that count as symbols.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _numbered(body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Numbers of the parts of ``body`` between ``bounds``; equal parts have equal numbers."""
    parts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body)))
    return parts.cast(pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


def measure_texts(texts: pa.LargeStringArray) -> dict[str, np.ndarray]:
    """The five measures of each text."""
    body, at = bytes_of(texts)
    n_docs = len(texts)
    out = {m: np.zeros(n_docs, np.int64) for m in MEASURES}
    if not len(body):
        return out
    space = _SPACE[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[at] = True
    bounds = np.flatnonzero(edge)
    is_word = ~space[bounds[:-1]]
    doc = np.searchsorted(at, bounds[:-1], "right") - 1
    word_doc = doc[is_word]
    out["n_words"] = np.bincount(word_doc, minlength=n_docs)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[at[1:]] - total[at[:-1]]

    out["word_chars"] = per_doc(~space & ((body & 0xC0) != 0x80))
    out["n_symbols"] = per_doc(_SYMBOL[body])

    word = _numbered(body, bounds)[is_word].astype(np.uint64)
    if len(word) > 2:
        window = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        key = mixed(mixed(mixed(word[window] + np.uint64(1)) + word[window + 1]) + word[window + 2]) + mixed(word_doc[window].astype(np.uint64) + np.uint64(1 << 40))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(window), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        repeated = np.zeros(len(word), bool)
        for k in range(3):
            repeated[window[twice] + k] = True
        out["n_repeat_words"] = np.bincount(word_doc[repeated], minlength=n_docs)

    newline = body == 10
    edge[:] = False
    edge[:-1] |= newline
    edge[1:] |= newline
    edge[at] = True
    bounds = np.flatnonzero(edge)
    line_doc = np.searchsorted(at, bounds[:-1], "right") - 1
    words_before = np.concatenate([[0], np.cumsum(~space)])
    with_word = words_before[bounds[1:]] > words_before[bounds[:-1]]
    line = _numbered(body, bounds)[with_word]
    pairs = line_doc[with_word] * (len(bounds) + 1) + line
    out["n_dup_lines"] = np.bincount(line_doc[with_word], minlength=n_docs) - np.bincount(np.unique(pairs) // (len(bounds) + 1), minlength=n_docs)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks(batches):
        found = measure_texts(texts)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "host": batch.column("host").cast(pa.string()), **{m: pa.array(v, pa.int64()) for m, v in found.items()}})


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, ``host`` and the measures of every row."""
    schema = "doc_id bigint, host string, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return map_texts(docs.select("doc_id", F.col(host).alias("host"), "text"), _measure, schema)


def rules() -> dict[str, Column]:
    """Failure of each rule; none is NULL."""
    words = F.col("n_words")
    return {
        "base": (words < 50) | (100 * F.col("n_repeat_words") > 50 * words),
        "marks": 5 * F.col("n_symbols") > words,
        "lines": 5 * F.col("n_dup_lines") > F.greatest(words, F.lit(10)),
        "long_words": F.col("word_chars") > 15 * words,
    }


def beta_prior(k: int, total: float, squares: float, failures: float, spread: float, bounds: tuple[float, float]) -> tuple[float, float]:
    """Mean and weight of the prior from sums over hosts; ``spread`` is the sum of failures^2 / documents."""
    low, high = bounds
    m = failures / total if total else 0.0
    room = total - squares / total - (k - 1) if total else 0.0
    if not 0 < m < 1 or room <= 0:
        return m, high
    between = ((spread - total * m * m) / (m * (1 - m)) - (k - 1)) / room
    return m, (high if between <= 0 else min(high, max(low, 1 / between - 1)))


def host_rates(judged: DataFrame, names: list[str], *, host_limit: float, weight_bounds: tuple[float, float]) -> DataFrame:
    """Per host: documents, shrunk rate and verdict of each rule."""
    sums = [F.sum(F.col(f"fails_{r}").cast("bigint")).alias(f"n_{r}") for r in names]
    hosts = stored(judged.groupBy("host").agg(F.count("*").alias("n_docs"), *sums), "host-sums")
    n = F.col("n_docs").cast("double")
    parts = [F.count("*").alias("k"), F.sum(n).alias("N"), F.sum(n * n).alias("n2")]
    for r in names:
        f = F.col(f"n_{r}").cast("double")
        parts += [F.sum(f).alias(f"f_{r}"), F.sum(f * f / n).alias(f"f2_{r}")]
    all_hosts = hosts.agg(*parts).first()
    columns = [F.col("host"), F.col("n_docs").alias("host_docs")]
    for r in names:
        m, weight = beta_prior(all_hosts.k, all_hosts.N, all_hosts.n2, all_hosts[f"f_{r}"], all_hosts[f"f2_{r}"], weight_bounds)
        shrunk = (F.col(f"n_{r}") + F.lit(weight * m)) / (F.col("n_docs") + F.lit(weight))
        columns += [shrunk.alias(f"rate_{r}"), (shrunk > host_limit).alias(f"bad_{r}")]
    return hosts.select(*columns)


def judge(docs: DataFrame, *, host: str = "source", host_limit: float = 0.5, weight_bounds: tuple[float, float] = (2.0, 1000.0)) -> DataFrame:
    """Measures, rule failures, host verdicts and ``kept`` of every row."""
    checks = rules()
    judged = stored(measure(docs, host), "host-measures").withColumns({f"fails_{r}": c for r, c in checks.items()})
    rates = host_rates(judged, list(checks), host_limit=host_limit, weight_bounds=weight_bounds)
    joined = join_stats(judged, stored(rates, "host-verdicts"), "host")
    bad = F.lit(False)
    for r in checks:
        bad = bad | F.col(f"fails_{r}") | F.col(f"bad_{r}")
    return joined.withColumn("base_failed", F.col("fails_base")).withColumn("kept", ~bad)
