"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes, each ``OVERLAP`` bytes into the one before, so that the
chunks cover all of it. Bytes become learned vectors; learned filters of ``2 * STRIDE`` bytes slide over
a chunk in steps of ``STRIDE``; the largest value of each filter (at least 0) stands for the chunk. The
mean over all chunks of a text, weighted by learned factors, gives one probability. A filter over two
steps is two products of one step, so a chunk needs one matrix product and no copies of windows.

``fit`` learns filters, vectors and weights together (Adam on the log loss) from at most about ``train_docs``
labelled documents per class, a hash sample, each with at most ``TRAIN_CHUNKS`` chunks spread over its text: what reaches
the driver is bounded by these numbers. The bias is then moved to the true share of the classes.

Edge cases: NULL and empty texts are one chunk of zero bytes; labels other than 0 and 1, and NULL labels, are not
learned; of several labels for one ``doc_id`` the largest counts; with labels of one class only (or none) every score is
that class's share (or 0.5); further columns are ignored; rows with an equal ``doc_id`` are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fleetlens.llm.tables import blocks, bytes_of, map_texts

CHUNK, OVERLAP, STRIDE, TRAIN_CHUNKS = 512, 64, 4, 8
_STEP = CHUNK - OVERLAP


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk its text and its first byte in the text."""
    count = np.maximum(1, -(-(sizes - OVERLAP) // _STEP))
    text = np.repeat(np.arange(len(sizes)), count)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * _STEP


def chunk_bytes(body: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes from ``first`` on, zero after ``size`` of them."""
    place = np.arange(CHUNK)
    index = first[:, None] + place
    inside = place < size[:, None]
    padded = body if len(body) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(index, len(padded) - 1)], np.uint8(0))


@dataclass
class Network:
    vectors: np.ndarray  # (256, d)
    filters: np.ndarray  # (STRIDE * d, 2 * f): of the first and of the second step
    offsets: np.ndarray  # (f,)
    weights: np.ndarray  # (f,)
    bias: float

    def _places(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, places, f) values of the filters."""
        steps = self.vectors[chunks].reshape(len(chunks) * (CHUNK // STRIDE), -1) @ self.filters
        steps = steps.reshape(len(chunks), CHUNK // STRIDE, -1)
        f = len(self.offsets)
        return steps[:, :-1, :f] + steps[:, 1:, f:]

    def pooled(self, chunks: np.ndarray, batch: int = 128) -> np.ndarray:
        out = np.empty((len(chunks), len(self.offsets)), np.float32)
        for i in range(0, len(chunks), batch):
            out[i : i + batch] = self._places(chunks[i : i + batch]).max(axis=1)
        return np.maximum(out + self.offsets, 0)

    def scores(self, texts: pa.LargeStringArray) -> np.ndarray:
        body, at = bytes_of(texts)
        text, start = chunk_starts(np.diff(at))
        first, size = at[text] + start, np.minimum(np.diff(at)[text] - start, CHUNK)
        total = np.zeros((len(texts), len(self.offsets)))
        for i in range(0, len(text), 2048):
            part = slice(i, i + 2048)
            np.add.at(total, text[part], self.pooled(chunk_bytes(body, first[part], size[part])))
        mean = total / np.bincount(text, minlength=len(texts))[:, None]
        return 1 / (1 + np.exp(-np.clip(mean @ self.weights + self.bias, -30, 30)))


def train(chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, share: float, *, dims: int = 8, filters: int = 24, epochs: int = 20, batch: int = 32, rate: float = 8e-3, seed: int = 0) -> Network:
    """Fit to ``chunks`` of documents ``doc`` (sorted numbers from 0) with ``label`` per document; ``share`` is the true share of 1."""
    rng = np.random.default_rng(seed)
    p = {
        "vectors": rng.normal(0, 0.5, (256, dims)),
        "filters": rng.normal(0, (2 * STRIDE * dims) ** -0.5, (STRIDE * dims, 2 * filters)),
        "offsets": np.zeros(filters),
        "weights": rng.normal(0, 0.3, filters),
        "bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    at = np.searchsorted(doc, np.arange(len(label) + 1))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        pace = rate * (1 - epoch / epochs)
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            rows = np.concatenate([np.arange(at[d], at[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), at[docs + 1] - at[docs])
            counts = np.bincount(own, minlength=len(docs)).astype(np.float32)
            net = Network(p["vectors"], p["filters"], p["offsets"], p["weights"], 0.0)
            x = chunks[rows]
            values = net._places(x)
            best = values.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(values, best[:, None, :], 1)[:, 0] + p["offsets"], 0)
            mean = np.zeros((len(docs), filters), np.float32)
            np.add.at(mean, own, pooled)
            mean /= counts[:, None]
            error = 1 / (1 + np.exp(-np.clip(mean @ p["weights"] + p["bias"], -30, 30))) - label[docs]
            error = (error / len(docs)).astype(np.float32)
            g = {"weights": mean.T @ error + 1e-4 * p["weights"], "bias": error.sum(keepdims=True)}
            back = (error / counts)[own][:, None] * p["weights"] * (pooled > 0)
            g["offsets"] = back.sum(axis=0)
            window = np.arange(2 * STRIDE)
            seen = x[np.arange(len(x))[:, None, None], best[:, :, None] * STRIDE + window]  # (chunks, f, 2 * STRIDE) bytes
            vectors = p["vectors"][seen].reshape(len(x), filters, 2, -1)
            both = np.einsum("cf,cfhk->hkf", back, vectors)
            g["filters"] = np.concatenate([both[0], both[1]], axis=1)
            halves = p["filters"].reshape(-1, 2, filters)  # (STRIDE * d, half, f)
            to_vectors = np.einsum("cf,khf->cfhk", back, halves).reshape(-1, dims)
            g["vectors"] = np.zeros_like(p["vectors"])
            np.add.at(g["vectors"], seen.ravel(), to_vectors)
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                p[k] -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    seen_share = np.clip(label.mean(), 1e-6, 1 - 1e-6)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    shift = np.log(share / (1 - share)) - np.log(seen_share / (1 - seen_share))
    return Network(p["vectors"], p["filters"], p["offsets"], p["weights"], float(p["bias"][0] + shift))


def constant(share: float) -> Network:
    """A network that gives every text the same score."""
    share = np.clip(share, 1e-6, 1 - 1e-6)
    one = np.zeros(1, np.float32)
    return Network(np.zeros((256, 1), np.float32), np.zeros((STRIDE, 2), np.float32), one, one, float(np.log(share / (1 - share))))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks(batches):
        body, at = bytes_of(texts)
        sizes = np.diff(at)
        text, start = chunk_starts(sizes)
        count = np.bincount(text, minlength=len(texts))
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        # every k-th chunk, so that the rows kept are spread over the text
        kept = (number * TRAIN_CHUNKS // count[text]) > ((number - 1) * TRAIN_CHUNKS // count[text])
        kept |= count[text] <= TRAIN_CHUNKS
        text, start = text[kept], start[kept]
        rows = chunk_bytes(body, at[text] + start, np.minimum(sizes[text] - start, CHUNK))
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        data = [rows[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_pydict({"quality": batch.column("quality").cast(pa.int32()), "chunks": pa.array(data, pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, *, train_fold: Column, train_docs: int = 1500, seed: int = 0, **options) -> Network:
    """Learn from the labelled rows where ``train_fold`` (over ``doc_id``) holds."""
    usable = labels.where(train_fold & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return constant(counts.get(1, 0) / total if total else 0.5)
    share = F.when(F.col("quality") == 1, F.lit(min(1.0, train_docs / counts[1]))).otherwise(F.lit(min(1.0, train_docs / counts[0])))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < share * float(1 << 30))
    # about 2 * train_docs narrow rows
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "quality")
    rows = sorted((r.chunks, r.quality) for r in map_texts(joined, _train_rows, "quality int, chunks binary").collect())
    if len({q for _, q in rows}) < 2:
        return constant(counts[1] / total)
    chunks = [np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for c, _ in rows]
    doc = np.repeat(np.arange(len(rows)), [len(c) for c in chunks])
    return train(np.concatenate(chunks), doc, np.array([q for _, q in rows], np.float32), counts[1] / total, seed=seed, **options)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """All columns of ``docs`` (a clashing ``score`` is replaced) and the probability that the text is of quality 1."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kept = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            scores = pa.array(shared.value.scores(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    return map_texts(kept, run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
